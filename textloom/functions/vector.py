"""Vectors and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIDPOINT, STEEPNESS = 0.65, 15.0


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """A zero vector stays."""
    # As a variable, the norm is computed once, and not for every element.
    return F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(_double(v), lambda x: x / n)).otherwise(_double(v)))[0]


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 if either is zero; vectors of unlike lengths are an error."""
    n = norm(a) * norm(b)
    value = F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")).otherwise(value)


def calibrate_score(raw: Column, midpoint: float = MIDPOINT, steepness: float = STEEPNESS) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-float(steepness)) * (raw - F.lit(float(midpoint)))))


def similarity_from_embeddings(a: Column, b: Column, midpoint: float = 0.82, steepness: float = STEEPNESS) -> Column:
    return calibrate_score(cosine_similarity(a, b), midpoint, steepness)


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))).otherwise(F.lit(0.0))


def cluster_uuid(root: Column) -> Column:
    """cluster_ and the version 5 UUID of the name in the DNS namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), F.encode(root, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(F.lit("cluster_"), F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def short_id(terms: Column) -> Column:
    """Eight characters decided by a set of terms."""
    return F.substring(F.sha2(F.concat_ws("\x1f", F.array_sort(terms)), 256), 1, 8)
