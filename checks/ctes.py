"""The jobs' intermediate tables as DuckDB SQL, written apart from the Spark code: only
word lists and constants are shared. ``with_tables`` puts together what a query needs."""

from __future__ import annotations

import re

from shelfmark.functions import categories as cat
from shelfmark.operators.kmeans import RFM
from shelfmark.operators.rfm import SEGMENT_NAMES
from shelfmark.sources.retail import RULE_METRICS
from shelfmark.sources.star import PHRASES

# centres on scaled recency, frequency and value that stand in for fitted ones
CENTRES = [
    [-0.2, 0.0, -0.1], [1.5, -0.7, -0.6], [-0.7, 1.3, 1.3], [-0.8, 2.3, 2.8], [-0.5, 0.6, 0.5],
]

# snake-case names of the rule metrics
METRIC = {m: m.replace(" ", "_") for m in RULE_METRICS}


def q(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def category_case(n: str = "n") -> str:
    out = ["CASE", f"WHEN {n} IS NULL THEN 'unknown'"]
    for words, name in cat.STRONG_PHRASES:
        out.append(f"WHEN regexp_matches({n}, '\\b({'|'.join(words)})\\b') THEN '{name}'")
    out.append(f"WHEN contains({n}, '{cat.COLLECTION[0]}') THEN '{cat.COLLECTION[1]}'")
    for word, name in cat.SET_PHRASES:
        out.append(
            f"WHEN (contains({n}, 'set of') OR contains({n}, 'set ')) AND contains({n}, '{word}') "
            f"THEN '{name}'"
        )
    out.append(f"WHEN regexp_matches({n}, '\\bmetal sign\\b') THEN 'sign'")
    out += [f"WHEN contains({n}, '{p}') THEN '{p}'" for p in cat.KEY_PHRASES]
    for word in cat.PRODUCT_WORDS:
        for second, name in cat.PRODUCT_SPECIALS.get(word, []):
            out.append(f"WHEN contains({n}, '{word}') AND contains({n}, '{second}') THEN '{name}'")
        out.append(f"WHEN contains({n}, '{word}') THEN '{word}'")
    tokens = f"string_split(trim({n}), ' ')"
    theme = f"regexp_extract({n}, '\\b({'|'.join(cat.THEMES)})\\b', 1)"
    out.append(
        f"WHEN {theme} <> '' THEN coalesce(list_filter({tokens}, lambda t: len(t) > 2 AND "
        f"t NOT IN ({q(cat.THEME_STOPWORDS)}) AND t <> {theme})[1] || ' ' || {theme}, "
        f"{theme} || ' item')"
    )
    place = f"regexp_extract({n}, '({'|'.join(cat.LOCATIONS)})', 1)"
    out.append(f"WHEN {place} <> '' THEN 'souvenir ' || {place}")
    out += [f"WHEN ends_with({n}, '{w}') THEN '{w}'" for w in cat.ENDINGS]
    skip = q(cat.COLOURS + cat.SIZES)
    content = (
        f"list_filter({tokens}, lambda t: len(t) > 2 AND t NOT IN ({q(cat.STOPWORDS)}) "
        f"AND t NOT IN ({skip}))"
    )
    out.append(f"WHEN len({content}) >= 2 THEN {content}[1] || ' ' || {content}[2]")
    out.append(f"WHEN len({content}) = 1 THEN {content}[1]")
    out.append(
        f"ELSE coalesce(list_filter({tokens}, lambda t: len(t) > 2 AND t NOT IN ({skip}))[1], "
        f"nullif({tokens}[1], ''), 'misc') END"
    )
    return " ".join(out)


def normalise(d: str) -> str:
    return (
        f"regexp_replace(regexp_replace(regexp_replace(lower(trim({d})), '[^a-z0-9_\\s]', ' ', 'g'), "
        f"'\\b[0-9]+\\b', '', 'g'), '\\s+', ' ', 'g')"
    )


def nearest_centre() -> str:
    gaps = [
        "[" + ", ".join(
            " + ".join(
                f"({f.lower()}_z - ({x}::DOUBLE)) * ({f.lower()}_z - ({x}::DOUBLE))"
                for f, x in zip(RFM, c)
            )
            for c in CENTRES
        ) + "]"
    ][0]
    return f"(list_position({gaps}, list_min({gaps})) - 1)::INTEGER"


def names_case(c: str = '"Cluster"') -> str:
    whens = " ".join(f"WHEN {c} = {k} THEN '{v}'" for k, v in SEGMENT_NAMES.items())
    return f"CASE {whens} ELSE 'Cluster_' || {c} END"


SEQ = "seq_line, seq_part, seq_supp, seq_price"

TABLES: dict[str, str] = {}

TABLES["raw"] = f"""
SELECT CASE WHEN o_orderkey % 23 = 0 THEN 'C' WHEN o_orderkey % 41 = 0 THEN 'A' ELSE '' END
         || lpad(o_orderkey::VARCHAR, 12, '0') AS "InvoiceNo",
       stock::VARCHAR AS "StockCode",
       CASE WHEN l_partkey % 89 = 0 THEN NULL
            WHEN l_linenumber % 5 = 0 THEN '  ' || lower(phrase) || ' ' ELSE phrase END AS "Description",
       (l_quantity * CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN -1 ELSE 1 END)::BIGINT
         AS "Quantity",
       CASE WHEN o_orderkey % 211 = 0 THEN 'not a date'
            ELSE strftime(o_orderdate + to_minutes(o_orderkey % 1440), '%-m/%-d/%Y %-H:%M') END
         AS "InvoiceDate",
       CASE WHEN l_partkey % 101 = 0 THEN '0'
            ELSE (cents // 100)::VARCHAR || CASE WHEN l_partkey % 2 = 0 THEN ',' ELSE '.' END
                 || lpad((cents % 100)::VARCHAR, 2, '0') END AS "UnitPrice",
       CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey::VARCHAR END AS "CustomerID",
       CASE WHEN (o_custkey + l_linenumber) % 97 = 0 THEN NULL
            WHEN n_nationkey = 24 THEN 'Unspecified'
            WHEN n_nationkey % 2 = 1 THEN '  ' || n_name || ' ' ELSE n_name END AS "Country",
       l_linenumber AS seq_line, l_partkey AS seq_part, l_suppkey AS seq_supp,
       l_extendedprice AS seq_price
FROM (
  SELECT *, 45 + (stock * 79) % 1900 + CASE WHEN l_linenumber = 6 THEN 100 ELSE 0 END AS cents,
         [{q(PHRASES)}][product + 1] AS phrase
  FROM (
    SELECT *, 10000 + product * 20 + l_suppkey % 20 AS stock
    FROM (
      SELECT *, (o_orderkey % 5) * 9 + floor(sqrt((l_partkey % 81)::DOUBLE))::BIGINT AS product
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)))
"""

TABLES["identified"] = """
SELECT * REPLACE (coalesce("CustomerID", 'Guest_' || "InvoiceNo") AS "CustomerID")
FROM raw WHERE "Description" IS NOT NULL
"""


def _first(c: str) -> str:
    return f'first("{c}" ORDER BY {SEQ}) FILTER ("{c}" IS NOT NULL) AS "{c}"'


TABLES["merged"] = f"""
SELECT "InvoiceNo", "StockCode", "UnitPrice", sum("Quantity")::BIGINT AS "Quantity",
       {_first("InvoiceDate")}, {_first("CustomerID")}, {_first("Country")}, {_first("Description")}
FROM identified
WHERE "InvoiceNo" IS NOT NULL AND "StockCode" IS NOT NULL AND "UnitPrice" IS NOT NULL
GROUP BY "InvoiceNo", "StockCode", "UnitPrice"
"""

TABLES["clean0"] = f"""
SELECT *, {category_case("n")} AS "CategoryExtraction"
FROM (
  SELECT "InvoiceNo", "StockCode", price AS "UnitPrice", "Quantity",
         ts AS "InvoiceDate", "CustomerID", trim("Country") AS "Country",
         upper(trim("Description")) AS "Description", "Quantity" * price AS "TotalPrice",
         dayname(ts) AS "DayOfWeek", hour(ts)::INTEGER AS "Hour",
         {normalise('"Description"')} AS n
  FROM (SELECT *, replace("UnitPrice", ',', '.')::DOUBLE AS price,
               try_strptime("InvoiceDate", '%m/%d/%Y %H:%M') AS ts FROM merged)
  WHERE ("Country" <> 'Unspecified' OR "Country" IS NULL)
    AND NOT starts_with("InvoiceNo", 'C') AND NOT starts_with("InvoiceNo", 'A')
    AND "Quantity" > 0 AND price > 0)
"""

TABLES["clean"] = """
SELECT c.* EXCLUDE (n), f."Frequency",
       date_sub('day', c."InvoiceDate", (SELECT max("InvoiceDate") FROM clean0))::INTEGER AS "Recency"
FROM clean0 c JOIN (SELECT "CustomerID", count(DISTINCT "InvoiceNo") AS "Frequency"
                    FROM clean0 GROUP BY 1) f USING ("CustomerID")
"""

TABLES["rfm"] = """
SELECT * FROM (
  SELECT "CustomerID",
         date_sub('day', max("InvoiceDate"),
                  (SELECT max("InvoiceDate") + INTERVAL 1 DAY FROM clean))::INTEGER AS "Recency",
         count(DISTINCT "InvoiceNo") AS "Frequency", sum("TotalPrice") AS "Monetary",
         bool_or(starts_with("CustomerID", 'Guest_')) AS "IsGuest"
  FROM clean GROUP BY 1)
WHERE "Recency" IS NOT NULL AND "Monetary" IS NOT NULL
"""

TABLES["scaled"] = """
SELECT r.*, """ + ", ".join(
    f'("{f}" - avg("{f}") OVER ()) / stddev_pop("{f}") OVER () AS {f.lower()}_z' for f in RFM
) + " FROM rfm r"

TABLES["seg0"] = f'SELECT *, {nearest_centre()} AS "Cluster" FROM scaled'
TABLES["seg"] = f'SELECT *, {names_case()} AS "Cluster_Name" FROM seg0'

TABLES["lines"] = 'SELECT c.*, s."Cluster" FROM clean c JOIN seg s USING ("CustomerID")'

TABLES["invoices"] = """
SELECT "Cluster", "InvoiceNo",
       row_number() OVER (PARTITION BY "Cluster" ORDER BY length("InvoiceNo"), "InvoiceNo") AS place,
       count(*) OVER (PARTITION BY "Cluster") AS invoices
FROM (SELECT DISTINCT "Cluster", "InvoiceNo" FROM lines)
"""
TABLES["used"] = """
SELECT l.* FROM lines l JOIN invoices i USING ("Cluster", "InvoiceNo")
WHERE i.invoices <= 3000 OR i.place <= 1000
"""
TABLES["items"] = """
SELECT "Cluster", "InvoiceNo", "CategoryExtraction" AS item,
       min(row("StockCode", "UnitPrice")) AS first_seen
FROM lines GROUP BY 1, 2, 3
"""
TABLES["frequent"] = """
SELECT "Cluster", item, count(*) AS invoices FROM items JOIN
  (SELECT "Cluster", count(DISTINCT "InvoiceNo") AS n FROM items GROUP BY 1) USING ("Cluster")
GROUP BY "Cluster", item, n
HAVING count(*) >= CASE WHEN n < 100 THEN 2 WHEN n < 1000 THEN 3 ELSE 5 END
"""
TABLES["kept"] = """
SELECT i.* FROM items i SEMI JOIN frequent f USING ("Cluster", item)
"""
TABLES["baskets"] = """
SELECT "Cluster", "InvoiceNo", list(item ORDER BY item) AS items FROM kept GROUP BY 1, 2
"""
TABLES["itemsets"] = """
SELECT "Cluster", items, count(*) AS cnt, any_value(n) AS n
FROM (
  SELECT "Cluster", n, list_filter(basket, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS items
  FROM (SELECT "Cluster", n, items AS basket, unnest(range(1, 1 << len(items))) AS mask
        FROM baskets JOIN (SELECT "Cluster", count(*) AS n FROM baskets GROUP BY 1) USING ("Cluster")))
GROUP BY 1, 2 HAVING count(*) >= ceil(0.03::DOUBLE * any_value(n))
"""
TABLES["splits"] = """
SELECT "Cluster", cnt, n, cnt / n AS support,
       list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS a,
       list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 0) AS c
FROM (SELECT *, unnest(range(1, (1 << len(items)) - 1)) AS mask FROM itemsets WHERE len(items) > 1)
"""
TABLES["minedrules"] = """
SELECT *, confidence / consequent_support AS lift,
       support - antecedent_support * consequent_support AS leverage,
       CASE WHEN confidence < 1 THEN (1 - consequent_support) / (1 - confidence)
            ELSE 'inf'::DOUBLE END AS conviction
FROM (
  SELECT s.*, x.cnt / x.n AS antecedent_support, y.cnt / y.n AS consequent_support,
         s.support / (x.cnt / x.n) AS confidence
  FROM splits s JOIN itemsets x ON s."Cluster" = x."Cluster" AND s.a = x.items
  JOIN itemsets y ON s."Cluster" = y."Cluster" AND s.c = y.items)
WHERE confidence >= 0.3::DOUBLE AND n >= 10
"""
TABLES["points0"] = """
SELECT * FROM minedrules, (VALUES (0.03::DOUBLE), (0.05::DOUBLE)) s(min_support),
                          (VALUES (0.3::DOUBLE), (0.4::DOUBLE)) c(min_confidence)
WHERE cnt >= ceil(min_support * n) AND confidence >= min_confidence
"""
RULE_ORDER = "lift DESC, confidence DESC, support DESC, a, c"
TABLES["points"] = """
SELECT * REPLACE (
  CASE WHEN isinf(conviction) THEN coalesce(max(conviction) FILTER (NOT isinf(conviction))
       OVER (PARTITION BY "Cluster", min_support, min_confidence), 1.0)
       ELSE conviction END AS conviction) FROM points0
"""
TABLES["tuning"] = """
SELECT "Cluster", min_support, min_confidence, min_lift, count(*) AS num_rules,
       avg(lift) AS avg_lift, avg(confidence) AS avg_confidence, avg(leverage) AS avg_leverage
FROM points, (VALUES (1.2::DOUBLE), (1.5::DOUBLE)) l(min_lift)
WHERE lift >= min_lift GROUP BY 1, 2, 3, 4
"""
TABLES["best"] = """
SELECT i."Cluster", coalesce(b.min_support, 0.03) AS min_support,
       coalesce(b.min_confidence, 0.3) AS min_confidence, coalesce(b.min_lift, 1.2) AS min_lift
FROM (SELECT DISTINCT "Cluster" FROM itemsets) i LEFT JOIN (
  SELECT * FROM tuning WHERE num_rules BETWEEN 20 AND 1000
  QUALIFY row_number() OVER (PARTITION BY "Cluster" ORDER BY round(avg_lift, 9) DESC,
                             min_support, min_confidence, min_lift) = 1) b USING ("Cluster")
"""
TABLES["rules"] = """
SELECT p.* EXCLUDE (min_support, min_confidence) FROM points p JOIN best b
  ON p."Cluster" = b."Cluster" AND p.min_support = b.min_support
 AND p.min_confidence = b.min_confidence WHERE p.lift >= b.min_lift
"""


def item_list(x: str) -> str:
    return f"'[''' || array_to_string({x}, ''', ''') || ''']'"


_FILLED = ", ".join(
    f"coalesce(CASE WHEN NOT isinf({m}) THEN {m} END, median(CASE WHEN NOT isinf({m}) THEN {m} END) "
    f'OVER (PARTITION BY "Cluster")) AS {m}_f'
    for m in METRIC.values()
)
TABLES["filled"] = f"""
SELECT *, {item_list("a")} || '->' || {item_list("c")} AS rule_id, {_FILLED} FROM rules
"""
_SCALED = ", ".join(
    f'CASE WHEN min({m}_f) OVER w = max({m}_f) OVER w THEN 0.0 '
    f"ELSE ({m}_f - avg({m}_f) OVER w) / stddev_pop({m}_f) OVER w END AS {m}_z"
    for m in METRIC.values()
)
TABLES["prepared"] = f'SELECT *, {_SCALED} FROM filled WINDOW w AS (PARTITION BY "Cluster")'

Z = [f"{m}_z" for m in METRIC.values()]


def lof_tables(k: str = "20") -> dict[str, str]:
    """Neighbours and factors for one k expression over ``vectors(grp, id, x)``."""
    return {
        "vgroups": "SELECT grp, x, min(id) AS point, count(*) AS copies FROM vectors GROUP BY 1, 2",
        "vsizes": f"""
SELECT grp, sum(copies) AS n, least({k}, sum(copies) - 1) AS k FROM vgroups GROUP BY 1""",
        "near0": """
SELECT p.grp, p.point, o.point AS near,
       sqrt(list_sum(list_transform(list_zip(p.x, o.x),
            lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d,
       o.copies - CASE WHEN o.point = p.point THEN 1 ELSE 0 END AS copies, s.k
FROM vgroups p JOIN vgroups o ON p.grp = o.grp JOIN vsizes s ON s.grp = p.grp""",
        "near": """
SELECT *, least(copies, k - before) AS times FROM (
  SELECT *, coalesce(sum(copies) OVER (PARTITION BY grp, point ORDER BY round(d, 9), near
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM near0 WHERE copies > 0) WHERE before < k""",
        "kdist": "SELECT grp, point, max(d) AS kd FROM near GROUP BY 1, 2",
        "density": """
SELECT n.grp, n.point, 1 / (sum(times * greatest(kd, d)) / any_value(k) + 1e-10::DOUBLE) AS lrd
FROM near n JOIN kdist q ON q.grp = n.grp AND q.point = n.near GROUP BY 1, 2""",
        "pointfactor": """
SELECT n.grp, n.point, sum(times * o.lrd / p.lrd) / any_value(k) AS factor
FROM near n JOIN density o ON o.grp = n.grp AND o.point = n.near
JOIN density p ON p.grp = n.grp AND p.point = n.point GROUP BY 1, 2""",
        "factors": """
SELECT v.grp, v.id, f.factor FROM vectors v JOIN vgroups g ON v.grp = g.grp AND v.x = g.x
JOIN pointfactor f ON f.grp = g.grp AND f.point = g.point""",
    }


TABLES["vectors"] = f'SELECT "Cluster" AS grp, rule_id AS id, [{", ".join(Z)}] AS x FROM prepared'
TABLES |= lof_tables()

# a plain score in the forest's place: minus the squared distance from the cluster's centre
TABLES["scored"] = f"""
SELECT *, -({" + ".join(f"{z} * {z}" for z in Z)}) AS score FROM prepared
"""
TABLES["flagged"] = """
SELECT s.*, score - thr AS anomaly_score, (score - thr < 0)::INTEGER AS iso,
       (f.factor > 1.5)::INTEGER AS lof, ((score - thr < 0) AND f.factor > 1.5)::INTEGER AS both_flags
FROM scored s JOIN (SELECT "Cluster", quantile_cont(score, 0.07) AS thr FROM scored GROUP BY 1) t
  USING ("Cluster") JOIN factors f ON f.grp = s."Cluster" AND f.id = s.rule_id
"""
# mean absolute scaled metric over the flagged rules, in the importance's place
TABLES["importance"] = " UNION ALL ".join(
    f"""SELECT "Cluster", '{m}_normalized' AS feature, avg(abs({z})) AS importance FROM flagged
WHERE iso = 1 GROUP BY 1""" for m, z in zip(RULE_METRICS, Z)
)


def with_tables(select: str, extra: dict[str, str] | None = None) -> str:
    """``select`` with the tables it mentions, and those they mention, as CTEs."""
    tables = {**TABLES, **(extra or {})}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in tables:
            if name not in order and re.search(rf"(?:FROM|JOIN)\s+\(*\s*{name}\b", text):
                visit(tables[name])
                if name not in order:
                    order.append(name)

    visit(select)
    if not order:
        return select
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({tables[n].strip()})" for n in order)
    return f"WITH {ctes}\n{select}"
