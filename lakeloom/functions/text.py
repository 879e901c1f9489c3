"""Column expressions for text: normalisation, tokenizers, inverted abstracts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stop words.
STOP_WORDS = """
able about above across after against almost alone along already all also although always another any are around been before
being below among based because become becomes becoming between beyond both but can cannot could could during each either else
first for from had has have having how however into its may might more most not other our out over paper per research results
same should show shown study such than that the their then there these this those through thus too under use used using via was
well were when where whether which while who whose with within without would and
""".split()


def collapse(text: Column) -> Column:
    """White space collapsed and trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def normalize(text: Column) -> Column:
    """Lower case, punctuation as spaces, single spaces; null if nothing is left."""
    return collapse(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " "))


def normalize_doi(doi: Column) -> Column:
    """A DOI as a lower-case URL: bare and doi: forms get the prefix; blank becomes null; others stay."""
    d = F.lower(F.trim(doi))
    bare = F.trim(F.regexp_replace(d, "^doi:", ""))
    return F.when(F.trim(doi) == "", None).when(d.startswith("https://doi.org/"), d).when(bare.startswith("10."), F.concat(F.lit("https://doi.org/"), bare)).otherwise(bare)


def short_id(value: Column) -> Column:
    """The id without the address before its last slash."""
    return F.regexp_replace(value, "^https?://.*/", "")


def corpus_tokens(text: Column) -> Column:
    """array of ASCII words: lower case, three or more characters, no stop words, no numbers; repeats stay."""
    words = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " ")
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(sorted(set(STOP_WORDS))) & ~w.rlike("^[0-9]+$"))


def query_tokens(text: Column) -> Column:
    """The same with words of letters and digits of any script."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " ")
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(sorted(set(STOP_WORDS))) & ~w.rlike(r"^\p{N}+$"))


def invert(text: Column) -> Column:
    """array<struct<position, token>> of the words of a text."""
    return F.transform(F.split(text, r"\s+"), lambda w, i: F.struct(i.alias("position"), w.alias("token")))


def inverted(words: Column) -> Column:
    """map<token, array<position>> of an array of words, positions from 0 in order: the words are sorted once and cut
    where the word changes."""
    def cut(pairs):  # a run of equal words goes from its start to the next one's
        last = F.size(pairs)
        changes = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (i == last) | (F.get(pairs, i)["t"] != F.get(pairs, i - 1)["t"]))
        return F.transform(F.array(changes), lambda starts: F.map_from_entries(F.transform(
            F.slice(starts, 1, F.size(starts) - 1),
            lambda s, k: F.struct(F.get(pairs, s)["t"].alias("t"), F.transform(F.slice(pairs, s + 1, F.get(starts, k + 1) - s), lambda x: x["p"]).alias("ps")),
        )))

    pairs = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("t"), i.alias("p"))))
    return F.get(F.get(F.transform(F.array(pairs), cut), F.lit(0)), F.lit(0))


def rebuild(index: Column) -> Column:
    """The text of an inverted index map<token, array<position>>: tokens by position, then token; null if there are none."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("t")))))
    return F.nullif(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["t"]), " "), F.lit(""))


def smoothed_idf(documents: Column, frequency: Column) -> Column:
    return F.ln((documents + 1) / (frequency + 1)) + 1
