"""Statistics and lexical features, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FEATURE_ORDER


def entropy_of(text: Column) -> Column:
    """Base-2 character entropy; 0 for an empty or missing text. The sorted text is cut into runs of one character each."""
    runs, n = F.regexp_extract_all(F.array_join(F.sort_array(F.split(text, "")), ""), F.lit(r"(?s)(.)\1*+"), F.lit(0)), F.length(text)
    return F.coalesce(F.when(n > 0, F.aggregate(runs, F.lit(0.0), lambda s, r: s - F.length(r) / n * F.log2(F.length(r) / n))), F.lit(0.0))


def entropy_from_counts(count: Column) -> Column:
    """An aggregate: base-2 entropy of non-negative counts, one row for each distinct value. Needs sum(c log2 c) and sum(c) alone, so it is combined before any shuffle."""
    n, s = F.sum(count), F.sum(F.when(count > 0, count * F.log2(count)).otherwise(0.0))
    return F.when(n > 0, F.log2(n) - s / n).otherwise(0.0)


def quantile_of(values: Column, q: float) -> Column:
    """Linear interpolation in an array; 0 for an empty one."""
    s, n = F.array_sort(values), F.size(values)
    at = F.lit(q) * (n - 1)
    low = F.floor(at).cast("int")
    a, b = F.get(s, low), F.get(s, F.least(low + 1, n - 1))
    return F.when(n > 0, a + (b - a) * (at - low)).otherwise(0.0)


def nearest_rank(values: Column, q: float) -> Column:
    """The ceil(q n)-th smallest."""
    return F.element_at(F.array_sort(values), F.greatest(F.ceil(F.lit(q) * F.size(values)).cast("int"), F.lit(1)))


def mad_of(values: Column) -> Column:
    """Median absolute deviation, not scaled; 0 for an empty array."""
    return quantile_of(F.transform(values, lambda v: F.abs(v - quantile_of(values, 0.5))), 0.5)


def robust_z_feature(x: Column, median: Column, mad: Column) -> Column:
    """0.67448975 (x - median) / MAD; infinite off a flat baseline, 0 on it or without one."""
    flat = F.when(x == median, 0.0).when(x > median, float("inf")).otherwise(float("-inf"))
    return F.when(median.isNull() | mad.isNull(), 0.0).when(mad == 0, flat).otherwise(0.67448975 * (x - median) / mad)


def robust_z_rate(x: Column, median: Column, mad: Column) -> Column:
    """(x - median) / (1.4826 MAD); the plain difference off a flat baseline."""
    return F.when(mad <= 1e-6, F.when(F.abs(x - median) < 1e-6, 0.0).otherwise(x - median)).otherwise((x - median) / (1.4826 * mad))


def cv_population(x: Column) -> Column:
    """An aggregate: population deviation over the mean's size; 0 for fewer than two values or mean 0."""
    return F.when((F.count(x) < 2) | (F.avg(x) == 0), 0.0).otherwise(F.stddev_pop(x) / F.abs(F.avg(x)))


def mean_of(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)).otherwise(0.0)


def labels_of(qname: Column) -> Column:
    """Non-empty labels of a name in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(qname, F.lit(""))), "[.]"), lambda x: x != "")


def primary_label(qname: Column) -> Column:
    return F.coalesce(F.get(labels_of(qname), 0), F.lit(""))


def share_matching(text: Column, pattern: str) -> Column:
    """Share of the characters that match a character class."""
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, f"[^{pattern}]", "")) / F.length(text)).otherwise(0.0)


def ngrams_of(text: Column, n: int) -> Column:
    count = F.length(text) - n + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda k: F.substr(text, k, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def language_score(text: Column, n: int, model: Column, floor: float = -12.0) -> Column:
    """Mean log probability of the n-grams under a map of probabilities; unseen ones count as the floor. 0 for a short text or an empty model."""
    grams = ngrams_of(text, n)
    one = F.transform(grams, lambda g: F.when(F.try_element_at(model, g).isNull(), floor).otherwise(F.log(F.greatest(F.try_element_at(model, g), F.lit(1e-12)))))
    return F.when((F.size(grams) == 0) | (F.coalesce(F.size(model), F.lit(0)) == 0), 0.0).otherwise(mean_of(one))


def domain_features(qname: Column, nxdomain_rate: Column, model: Column) -> dict[str, Column]:
    """The eight lexical features of a name's first label."""
    label = primary_label(qname)
    alnum = F.regexp_replace(label, "[^a-z0-9]", "")
    return {
        "length": F.length(label).cast("double"), "entropy": entropy_of(alnum), "digit_ratio": share_matching(label, "0-9"), "vowel_ratio": share_matching(label, "aeiou"),
        "label_count": F.size(labels_of(qname)).cast("double"), "lm_bigram": language_score(alnum, 2, model), "lm_trigram": language_score(alnum, 3, model), "nxdomain_rate": nxdomain_rate.cast("double"),
    }


def shape_features(sizes: Column) -> dict[str, Column]:
    values = F.transform(F.coalesce(sizes, F.array().cast("array<int>")), lambda v: v.cast("double"))
    return {"packet_size_mean": mean_of(values), "packet_size_p95": quantile_of(values, 0.95)}


def feature_vector(record: dict[str, Column]) -> Column:
    """The 20 features in their frozen order; missing ones are 0, and the list of packet sizes is its mean."""
    slots = [mean_of(F.transform(record[n], lambda v: v.cast("double"))) if n == "packet_size_first_n" and n in record else record.get(n, F.lit(0.0)) for n in FEATURE_ORDER]
    return F.array(*[F.coalesce(s.cast("double"), F.lit(0.0)) for s in slots])
