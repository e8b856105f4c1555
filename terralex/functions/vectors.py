"""Vector checks and arithmetic as Column expressions (the search kernel is in operators.knn)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terralex.functions.numeric import finite


def valid_vector(vector: Column, dimension: int) -> Column:
    return F.coalesce((F.size(vector) == dimension) & F.forall(vector, finite), F.lit(False))


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def squared_norm(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))


def cosine(left: Column, right: Column) -> Column:
    """Double accumulation; mismatched, non-finite or zero vectors fail the job."""
    usable = (
        (F.size(left) == F.size(right)) & (F.size(left) > 0)
        & F.forall(left, finite) & F.forall(right, finite)
        & (squared_norm(left) > 0) & (squared_norm(right) > 0)
    )
    value = dot(left, right) / F.sqrt(squared_norm(left) * squared_norm(right))
    return F.when(F.coalesce(usable, F.lit(False)), value).otherwise(
        F.raise_error(F.lit("vectors must be finite, non-zero and of equal dimension")).cast("double")
    )


def l2_normalised(vector: Column) -> Column:
    """Unit length in float32; a zero vector stays zero."""
    norm = F.greatest(F.sqrt(squared_norm(vector)), F.lit(1e-12))
    return F.transform(vector, lambda x: (x.cast("double") / norm).cast("float"))
