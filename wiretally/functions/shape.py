"""Shape features: lengths, entropy, character-class ratios. None tests for an attack token."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wiretally.functions import text as X

# The punctuation set and the statistics of one block.
PUNCTUATION = "'\"<>;{}()|&`"
STATS = ("len", "entropy", "nonalnum_ratio", "digit_ratio", "upper_ratio", "space_ratio",
         "punct_density")
BLOCKS = ("path", "query", "body", "hdr")
BASE_FEATURES = ("total_len", "query_param_count", "path_depth", "segment_count",
                 "encoding_depth", "pct_encoded_ratio")
#: Entropies are counted over so many characters at a time.
CHARACTERS = 1 << 18
FEATURE_NAMES = list(BASE_FEATURES) + [f"{b}_{s}" for b in BLOCKS for s in STATS]


def _share(part: Column, s: Column) -> Column:
    return F.when(F.length(s) > 0, part / F.length(s)).otherwise(F.lit(0.0))


def occurrences(s: Column, token: Column) -> Column:
    """How often a one-character token occurs."""
    return F.length(s) - F.length(F.replace(s, token, F.lit("")))


def _entropies(texts: pa.Array, lengths: np.ndarray) -> np.ndarray:
    """Entropy of each text, from the code points of all of them."""
    whole = "".join(texts.to_pylist())
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    keys = np.sort((np.repeat(np.arange(len(texts)), lengths) << 21) | points)
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    owner = keys[starts] >> 21
    share = np.diff(starts, append=len(keys)) / lengths[owner]
    return np.abs(np.bincount(owner, -share * np.log2(share), minlength=len(texts)))


def _entropy_of_long(text: str) -> float:
    """The same for one long text, counted piece by piece."""
    found: dict[int, int] = {}
    for at in range(0, len(text), CHARACTERS):
        points, n = np.unique(np.frombuffer(text[at:at + CHARACTERS].encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_counts=True)
        for p, k in zip(points.tolist(), n.tolist(), strict=True):
            found[p] = found.get(p, 0) + k
    share = np.array([found[p] for p in sorted(found)]) / len(text)
    return float(np.abs(np.sum(-share * np.log2(share))))


@F.arrow_udf(T.DoubleType())
def entropy(texts: pa.Array) -> pa.Array:
    """Shannon entropy over characters, base 2. The texts of an Arrow batch are counted together
    from their code points, at most ``CHARACTERS`` at a time, so a task holds little besides the batch; built from array functions the same took ten times as long."""
    texts = pc.fill_null(texts, "")
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    until, out, at = np.cumsum(lengths), np.empty(len(texts)), 0
    while at < len(texts):
        end = int(np.searchsorted(until, until[at] - lengths[at] + CHARACTERS, side="right"))
        if end == at:
            out[at], end = _entropy_of_long(texts[at].as_py()), at + 1
        else:
            out[at:end] = _entropies(texts.slice(at, end - at), lengths[at:end])
        at = end
    return pa.array(out)


def class_ratio(s: Column, pattern: str) -> Column:
    return _share(F.regexp_count(s, F.lit(pattern)), s)


def percent_encoded_ratio(raw: Column) -> Column:
    return class_ratio(raw, "%[0-9A-Fa-f]{2}")


def punctuation_density(s: Column) -> Column:
    return class_ratio(s, "['\"<>;{}()|&`]")


def block(name: str, s: Column) -> dict[str, Column]:
    """Seven statistics of one decoded text."""
    return {
        f"{name}_len": F.length(s).cast("double"),
        f"{name}_entropy": entropy(s),
        f"{name}_nonalnum_ratio": class_ratio(s, r"[^\p{L}\p{N}]"),
        f"{name}_digit_ratio": class_ratio(s, r"\p{Nd}"),
        f"{name}_upper_ratio": class_ratio(s, r"\p{Lu}"),
        f"{name}_space_ratio": class_ratio(s, r"(?U)[\s\x1c-\x1f]"),
        f"{name}_punct_density": punctuation_density(s),
    }


def with_shape_features(df: DataFrame) -> DataFrame:
    """Add the 34 feature columns. The decoded texts are staged first so that each is decoded
    once and not once per feature."""
    staged = X.with_detector_fields(df).withColumns({
        "_path": X.decode("url_path_raw"), "_query": X.decode("url_query"),
        "_body": X.decode("request_body")})
    path, query = F.col("_path"), F.col("_query")
    features = {
        "total_len": F.length("field_a").cast("double"),
        "query_param_count": occurrences(query, F.lit("=")).cast("double"),
        "path_depth": F.size(F.filter(F.split(path, "/"), lambda p: p != "")).cast("double"),
        "segment_count": F.size(F.split(path, "/", -1)).cast("double"),
        "encoding_depth": F.col("encoding_depth").cast("double"),
        "pct_encoded_ratio": percent_encoded_ratio(F.col("raw_target")),
    }
    for name, column in zip(BLOCKS, ("_path", "_query", "_body", "field_b")):
        features.update(block(name, F.col(column)))
    return staged.withColumns(features).drop("_path", "_query", "_body")


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.ln(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))
