"""Quality by compression: the class whose dictionary compresses a text better is the likelier one.

Two zstandard dictionaries are built, from texts labelled good and bad. A text is compressed with each, and the
difference of the compressed sizes, divided by their sum, is calibrated to a probability on other labelled texts.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import map_texts, per_task
from waymark.llm.learning import fold, labelled_sample, logistic, sigmoid

LEVEL = 3
#: Whole texts are compressed in pieces of so many bytes, so that a long text doesn't become its own dictionary.
PIECE = 512
DICTIONARY_BYTES = 1 << 16


def build_dictionary(texts: list[str], size: int = DICTIONARY_BYTES) -> bytes:
    """Dictionary of a class; with too few texts to train on, the texts themselves serve."""
    pieces = [p for t in texts for p in cut(t.encode())]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(pieces)[-size:]


def cut(raw: bytes) -> list[bytes]:
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


def compressor(dictionary: bytes):
    kind = zstandard.DICT_TYPE_AUTO
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
    data.precompute_compress(level=LEVEL)
    packer = zstandard.ZstdCompressor(dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False)

    def size(pieces: list[bytes]) -> int:
        return sum(len(packer.compress(p)) for p in pieces)

    return size


def differences(texts: list[str], good: bytes, bad: bytes) -> np.ndarray:
    """(size with the bad dictionary - size with the good one) / their sum, per whole text; 0 for an empty text."""
    with_good, with_bad = compressor(good), compressor(bad)
    out = np.zeros(len(texts))
    for i, t in enumerate(texts):
        if t:
            pieces = cut(t.encode())
            g, b = with_good(pieces), with_bad(pieces)
            out[i] = (b - g) / (b + g)
    return out


def train_quality(docs: DataFrame, labels: DataFrame, per_class: int = 3000, longest: int = 4096) -> dict:
    """Dictionaries and calibration from at most ``per_class`` labelled texts of each class (excerpts of ``longest``).

    Two thirds of them build the dictionaries, the rest calibrates. Labels of the held-out fold are never read. With no
    labelled text every score is 0.5.
    """
    texts = labelled_sample(docs, labels, "quality", per_class, longest)
    build = {y: [t for i, t in enumerate(texts[y]) if i % 3] for y in (0, 1)}
    rest = {y: texts[y][::3] for y in (0, 1)}
    good, bad = build_dictionary(build[1]), build_dictionary(build[0])
    if not good or not bad:
        return {"good": b"", "bad": b"", "weights": np.zeros(2)}
    x = 100 * differences(rest[0] + rest[1], good, bad)
    y = np.array([0] * len(rest[0]) + [1] * len(rest[1]))
    return {"good": good, "bad": bad, "weights": logistic(x[:, None], y)}


def score_quality(docs: DataFrame, model: dict) -> DataFrame:
    """``held_out``, ``score`` (0 to 1, higher: better) and ``predicted`` (1 from 0.5) in place of the text.

    Null and empty texts have difference 0, which gives the score of the calibration there. Repeated rows score alike.
    """
    good, bad, w = model["good"], model["bad"], model["weights"]

    @per_task
    def scorer():
        def columns(texts):
            d = differences(texts, good, bad) if good else np.zeros(len(texts))
            return {"score": sigmoid(w[0] + w[1] * 100 * d)}

        return columns

    scored = map_texts(docs, scorer, "score double")
    return scored.withColumns({"held_out": fold() == 1, "predicted": (F.col("score") >= 0.5).cast("int")})
