"""Product description to category, as one chain of substring tests.

The normalised text holds only letters, digits, underscores and single spaces, so a
word-bounded search equals a plain substring search in the text padded with one space
on each side. A word list is one literal array searched by a lambda: the projection stays
small, where a chain of ~150 tests would outgrow the size the JVM compiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import SPACE, null_to_unknown, strip

# ---- fixed values: word lists that decide a category, in order of precedence ----
STRONG_PHRASES = [
    (["chopsticks"], "chopsticks"),
    (["milk pan"], "milk pan"),
    (["pencil", "pencils"], "pencils"),
    (["pen"], "pen"),
    (["wrap"], "gift wrap"),
    (["tv dinner tray"], "tray"),
    (["breakfast set", "lunch set", "dinner set"], "dining set"),
    (["drawer knob"], "drawer knob"),
    (["necklace"], "necklace"),
    (["earring", "earrings"], "earrings"),
    (["bracelet"], "bracelet"),
    (["t light", "t lights"], "t-lights"),
    (["soft toy"], "soft toy"),
    (["cake tins"], "cake tins"),
    (["herb tins"], "herb tins"),
    (["spice tins"], "spice tins"),
    (["baking mould"], "baking mould"),
    (["ribbons"], "ribbons"),
    (["photo frame"], "photo frame"),
    (["danish rose"], "danish rose collection"),
    (["sewing box"], "sewing box"),
]
COLLECTION = ("danish rose", "danish rose collection")
SET_MARKERS = ["set of", "set "]
SET_PHRASES = [
    ("t light", "t-lights"),
    ("cake tin", "cake tins"),
    ("herb tin", "herb tins"),
    ("spice tin", "spice tins"),
    ("flying duck", "flying ducks"),
    ("gift wrap", "gift wrap"),
    ("cutlery", "cutlery"),
]
SIGN_PHRASE = ("metal sign", "sign")
KEY_PHRASES = [
    "money bank", "t light holder", "tea towel", "mug cosy", "bird ornament",
    "playhouse bedroom", "playhouse kitchen", "hot water bottle", "napkin charms",
    "building block word", "inflatable globe", "shopping bag", "hand warmer",
    "cake stand", "heart t light", "bathroom set", "lunch box", "sewing kit",
    "writing set", "glass cloche", "jigsaw puzzle", "mini jigsaw", "cabinet",
    "parasol", "mug", "bag", "balloons", "candle", "card holder",
    "heart wicker", "picnic basket", "flying ducks", "decorative plate", "photo frame",
    "trinket trays", "folding chair", "soft toy",
]
PRODUCT_WORDS = [
    "pencil", "pen", "chopstick", "drawer", "knob", "pan", "milk", "breakfast",
    "mug", "plate", "bowl", "spoon", "fork", "knife", "towel", "napkin",
    "earring", "frame", "tin", "toy", "baking", "ribbon",
]
# product word -> (second word that must also occur, category); "" is always there
PRODUCT_SPECIALS = {
    "drawer": [("knob", "drawer knob")],
    "milk": [("pan", "milk pan")],
    "breakfast": [("set", "breakfast set")],
    "earring": [("", "earrings")],
    "frame": [("photo", "photo frame")],
    "tin": [("cake", "cake tins"), ("herb", "herb tins"), ("spice", "spice tins")],
    "toy": [("soft", "soft toy")],
    "baking": [("mould", "baking mould")],
    "ribbon": [("", "ribbons")],
}
THEMES = ["christmas", "vintage", "retro", "classic", "modern", "easter"]
THEME_STOPWORDS = ["the", "of", "for", "and", "in", "on", "with"]
LOCATIONS = ["london", "paris", "england", "york"]
ENDINGS = ["mug", "parasol", "box", "globe", "sign", "towel", "bracelet", "necklace", "plate"]
STOPWORDS = [
    "the", "of", "and", "in", "on", "for", "with", "a", "to", "set", "pack", "mrs", "mr",
]
COLOURS = [
    "red", "blue", "green", "white", "black", "pink", "purple", "yellow",
    "turq", "turquoise", "silver",
]
SIZES = ["small", "large", "mini", "tall", "short", "big", "medium"]
# ---- end of fixed values ----

_WORD = r"[\p{L}\p{N}_]"


def normalise(description: Column) -> Column:
    """Lower case, symbols to blanks, standalone numbers gone, blanks collapsed.

    A blank left at either end by a removed number stays: it decides the ending test.
    """
    text = strip(F.lower(description))
    text = F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}_\p{{IsWhite_Space}}\x1c-\x1f]", " ")
    text = F.regexp_replace(text, rf"(?<!{_WORD})\p{{Nd}}+(?!{_WORD})", "")
    return F.regexp_replace(text, rf"{SPACE}+", " ")


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _first_in(words: list[str], test: str) -> str:
    """SQL for the first listed word ``w`` that passes ``test``, else NULL."""
    return f"get(filter(array({_quoted(words)}), w -> {test}), 0)"


def _lookup(word: str, pairs: list[tuple[str, str]]) -> str:
    entries = ", ".join(f"'{k}', '{v}'" for k, v in pairs)
    return f"element_at(map({entries}), {word})"


def _token(excluded: list[str]) -> str:
    """A whole word of three or more characters that is none of ``excluded``."""
    return rf"(?:^| )((?!(?:{'|'.join(excluded)})(?: |$))[^ ]{{3,}})"


def _extract(text: str, pattern: str) -> str:
    return f"nullif(regexp_extract({text}, r'{pattern}', 1), '')"


def category_sql(text: str, padded: str) -> str:
    """SQL of the category, given the normalised text and the same text padded with one
    space on each side; both must be columns, as every test reads one of them."""
    inside = f"contains({text}, w)"
    strong_pairs = [(f" {w} ", out) for words, out in STRONG_PHRASES for w in words]
    strong = _lookup(
        _first_in([w for w, _ in strong_pairs], f"contains({padded}, w)"), strong_pairs
    )
    collection = f"if(contains({text}, '{COLLECTION[0]}'), '{COLLECTION[1]}', NULL)"
    set_test = " OR ".join(f"contains({text}, '{m}')" for m in SET_MARKERS)
    in_set = _lookup(_first_in([w for w, _ in SET_PHRASES], inside), SET_PHRASES)
    sign = f"if(contains({padded}, ' {SIGN_PHRASE[0]} '), '{SIGN_PHRASE[1]}', NULL)"

    specials = []
    for word, rules in PRODUCT_SPECIALS.items():
        for second, out in rules:
            also = f" AND contains({text}, '{second}')" if second else ""
            specials.append(f"WHEN word = '{word}'{also} THEN '{out}'")
    product = (
        f"get(transform(filter(array({_quoted(PRODUCT_WORDS)}), w -> {inside}), "
        f"word -> CASE {' '.join(specials)} ELSE word END), 0)"
    )

    themed = "CASE " + _extract(padded, rf" ({'|'.join(THEMES)})(?= )")
    for name in THEMES:
        other = _extract(text, _token([*THEME_STOPWORDS, name]))
        themed += f" WHEN '{name}' THEN coalesce({other} || ' {name}', '{name} item')"
    themed += " END"

    location = f"'souvenir ' || {_extract(text, '(' + '|'.join(LOCATIONS) + ')')}"
    ending = _first_in(ENDINGS, f"endswith({text}, w)")
    content = _token([*STOPWORDS, *COLOURS, *SIZES])
    main_words = (
        f"nullif(array_join(slice(regexp_extract_all({text}, r'{content}', 1), 1, 2), ' '), '')"
    )
    plain = _extract(text, _token([*COLOURS, *SIZES]))
    first_word = _extract(text, "([^ ]+)")
    stages = [
        strong, collection, f"if({set_test}, {in_set}, NULL)", sign,
        _first_in(KEY_PHRASES, inside), product, themed, location, ending,
        main_words, plain, first_word, "'misc'",
    ]
    return f"if({text} IS NULL, NULL, coalesce({', '.join(stages)}))"


def with_category(
    df: DataFrame, description: str = "Description", output: str = "CategoryExtraction"
) -> DataFrame:
    """Add the category column; a missing description is ``unknown``.

    The normalised text is a projection of its own, which Catalyst keeps: it does not
    inline a costly expression that the next projection reads many times.
    """
    text, padded = "__normalised", "__padded"
    return (
        df.withColumn(text, normalise(F.col(description)))
        .withColumn(padded, F.concat(F.lit(" "), F.col(text), F.lit(" ")))
        .withColumn(output, null_to_unknown(F.expr(category_sql(text, padded))))
        .drop(text, padded)
    )
