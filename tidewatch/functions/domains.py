"""Registered domains, the allowlist and the rule score of generated names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ALLOWLIST, COMMON_BIGRAMS, COMMON_TLDS, NOT_OBSERVABLE
from .features import entropy_of


def cleaned(qname: Column) -> Column:
    return F.lower(F.rtrim(F.trim(qname), F.lit(".")))


def core_label(qname: Column) -> Column:
    """The label that is scored: the one before a common top-level domain, else the first."""
    labels = F.split(cleaned(qname), "[.]")
    n = F.size(labels)
    return F.when(n == 1, F.get(labels, 0)).when(F.element_at(labels, -1).isin(*COMMON_TLDS), F.get(labels, n - 2)).otherwise(F.get(labels, 0))


def label_count(qname: Column) -> Column:
    clean = cleaned(qname)
    return F.when(clean.startswith(".") | (clean == ""), 0).otherwise(F.size(F.split(clean, "[.]")))


def two_labels(qname: Column) -> Column:
    """The last two labels, or the only one."""
    labels = F.split(cleaned(qname), "[.]")
    return F.array_join(F.slice(labels, F.when(F.size(labels) > 1, -2).otherwise(1), F.when(F.size(labels) > 1, 2).otherwise(1)), ".")


def registered_domain(qname: Column) -> Column:
    """The last two labels, or the sentinel for fewer."""
    return F.when(F.size(F.split(cleaned(qname), "[.]")) >= 2, two_labels(qname)).otherwise(NOT_OBSERVABLE)


def registered_domain_dataset(qname: Column) -> Column:
    """The training sets' rule: three labels below co.in and gov.in, else two."""
    labels = F.split(F.lower(F.trim(qname, F.lit("."))), "[.]")
    keep = F.when(two_labels(qname).isin("co.in", "gov.in"), 3).otherwise(2)
    return F.array_join(F.reverse(F.slice(F.reverse(labels), F.lit(1), keep)), ".")


def is_allowlisted(qname: Column) -> Column:
    return cleaned(qname).isin(*ALLOWLIST) | two_labels(qname).isin(*ALLOWLIST)


def ngram_anomaly(label: Column) -> Column:
    """Share of letter pairs that aren't common; 0 for fewer than two letters."""
    letters = F.regexp_replace(F.lower(label), "[^a-z]", "")
    pairs, common = F.length(letters) - 1, F.regexp_count(letters, F.lit(f"(?={'|'.join(COMMON_BIGRAMS)})"))
    return F.when(pairs < 1, 0.0).otherwise((pairs - common) / pairs)


def lexical_features(qname: Column, core: Column | None = None) -> dict[str, Column]:
    core = core_label(qname) if core is None else core
    n = F.length(core)
    share = lambda pattern: F.when(n > 0, F.length(F.regexp_replace(core, f"[^{pattern}]", "")) / n).otherwise(0.0)
    return {"length": n.cast("double"), "entropy": entropy_of(core), "digit_ratio": share("0-9"), "vowel_ratio": share("aeiou"), "label_count": label_count(qname).cast("double")}


def rule_score(qname: Column, core: Column | None = None) -> Column:
    """0 to 1: entropy, odd letter pairs, vowels, length and digits of the core label; 0 for allowlisted names and cores under four characters. Parts are rounded to four digits before they are weighed. A column that holds core_label() already spares its work in each part."""
    core = core_label(qname) if core is None else core
    f = lexical_features(qname, core)
    four = lambda c: F.round(c, 4)
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    vowels = four(f["vowel_ratio"])
    odd_vowels = F.when(vowels < 0.2, 1 - vowels / 0.2).when(vowels > 0.65, 0.4).otherwise(0.0)
    total = 0.30 * clamp((four(f["entropy"]) - 2) / 1.6) + 0.25 * four(ngram_anomaly(core)) + 0.20 * odd_vowels + 0.15 * clamp((f["length"] - 6) / 10) + 0.10 * clamp(four(f["digit_ratio"]) * 2)
    return F.when(is_allowlisted(qname) | (F.length(core) < 4), 0.0).otherwise(F.round(clamp(total), 4))
