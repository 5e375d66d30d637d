"""Production parameters of the queries and the pipeline."""

from __future__ import annotations

import public_tokenizers

#: The vocabulary file of the token counts and segmentations, where the machine keeps it.
PIECES = public_tokenizers.path("piece_bpe_32k.model")

#: A document is rejected below this score.
KEPT_SCORE = 0.3

#: A document counts as toxic from this score.
TOXIC_SCORE = 0.5

#: Sources weigh the square root of their size; the mixture is as large as the input.
MIX = {"exponent": 0.5, "seed": 7}

#: Two segmentations of each text.
SAMPLES = {"k": 2, "sharpness": 1.0, "seed": 17}
