"""Text expressions on columns: tokens, stems, set similarity, path names and display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning for similarity.
STOP_WORDS = (
    "a an the and or for to of in on with from by via as is are be use using when after before into that this it its "
    "your not do does don't dont how what which"
).split()


def empty_if_null(array: Column) -> Column:
    return F.coalesce(array, F.expr("cast(array() as array<string>)"))


def tokens(text: Column) -> Column:
    """Lower-case words of three characters or more that are no stop words; nulls give none. Repeats stay."""
    parts = F.split(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("`"), F.lit("'")), "[^a-z0-9_']+")
    return F.filter(parts, lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS))


def stem(token: Column) -> Column:
    """Without one suffix (-ing, -ings, -ed, -er, -ers, -s), then without a doubled last letter."""
    return F.regexp_replace(F.regexp_replace(token, r"(ings?|ed|ers?|s)\z", ""), r"(.)\1\z", "$1")


def stems(text: Column) -> Column:
    return F.array_distinct(F.transform(tokens(text), stem))


def stems_of_all(texts: Column) -> Column:
    """Distinct stems of an array of texts."""
    return F.array_distinct(F.flatten(F.transform(empty_if_null(texts), stems)))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def dice(a: Column, b: Column) -> Column:
    """Twice the common share of two sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * overlap(a, b) / (F.size(a) + F.size(b))).otherwise(0.0)


def title_similarity(a: Column, b: Column) -> Column:
    """Dice of the distinct white-space separated lower-case words."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""))
    return dice(words(a), words(b))


def project_name(path: Column) -> Column:
    """The last two segments of a path, whichever slashes it has."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/")


def normal_path(path: Column) -> Column:
    return F.when(path.isNull() | (path == ""), "default").otherwise(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))))


def masked_key(key: Column) -> Column:
    return F.when(F.length(key) <= 8, "****").otherwise(F.concat(F.left(key, F.lit(4)), F.lit("..."), F.right(key, F.lit(4))))


def shortened(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def percent(share: Column) -> Column:
    return F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%"))


def xml_escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def signature(domain: Column, task_type: Column, tags: Column) -> Column:
    """``domain::task_type::tags...``, tags sorted; what is missing counts as "any"."""
    head = F.array(F.coalesce(domain, F.lit("any")), F.coalesce(task_type, F.lit("any")))
    return F.array_join(F.concat(head, F.array_sort(empty_if_null(tags))), "::")
