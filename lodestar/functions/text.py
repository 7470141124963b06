"""Column functions on text: folding, tokens, identities, normalisation, model replies."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What Python's \s matches, one by one (Java's own class for it is several times slower).
_BLANKS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{_BLANKS}]"
TOKEN = f"[^{_BLANKS}]+"
WORD = r"([\p{L}\p{N}_]+)"

# The words that the answer tokenizer leaves out.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "in", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with",
)


#: Text whose compatibility form is itself and whose case folding is lower case with ß as ss.
SIMPLE = r"\A[\x00-\x7f\u00bf-\u00ff\u00a1\u00ab\u00bb\u2013\u2014\u2018-\u201f]*\z"


def fold(text: Column) -> Column:
    """Case folding in built-in functions: upper and lower case (which takes ligatures and final letters apart as folding does), and ß as ss."""
    return F.replace(F.lower(F.upper(text)), F.lit("ß"), F.lit("ss"))


def bm25_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores after NFKC and case folding. Only text that is not SIMPLE goes through Python."""
    simple = text.rlike(SIMPLE)
    plain = F.regexp_extract_all(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit(WORD), F.lit(1))
    return F.when(simple, plain).otherwise(bm25_tokens_exact(F.when(~simple, text)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def bm25_tokens_exact(text: pd.Series) -> pd.Series:
    """As `bm25_tokens`, all in Python."""
    word = re.compile(r"\w+")
    return text.map(lambda t: word.findall(unicodedata.normalize("NFKC", t).casefold()) if t is not None else None)


def answer_tokens(text: Column) -> Column:
    """The set of folded ASCII words of two characters or more that are no stopwords."""
    words = F.regexp_extract_all(fold(text), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS)))


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def document_id(corpus: Column | str, source: Column) -> Column:
    corpus = F.lit(corpus) if isinstance(corpus, str) else corpus
    return F.substring(F.sha2(F.concat_ws(":", corpus, source), 256), 1, 16)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_id(doc_id: Column, digest: Column, start: Column, end: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", doc_id, digest, start.cast("string"), end.cast("string")), 256), 1, 16)


def corpus_slug(name: Column) -> Column:
    """A corpus id from a folder's name."""
    slug = F.regexp_replace(F.lower(name), r"[^a-z0-9._-]+", "-")
    slug = F.substring(F.regexp_replace(F.regexp_replace(slug, r"^[^a-z0-9]+", ""), r"-+$", ""), 1, 64)
    return F.when(slug == "", "default").otherwise(slug)


def valid_corpus_id(name: Column) -> Column:
    return F.coalesce(name.rlike(r"\A[a-z0-9][a-z0-9._-]{0,63}\z"), F.lit(False))


def valid_source(path: Column) -> Column:
    """A normalised relative POSIX path."""
    parts = F.split(path, "/")
    return F.coalesce((path != "") & ~F.contains(path, F.lit("\\")) & ~F.exists(parts, lambda p: p.isin("", ".", "..")), F.lit(False))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t) if t is not None else None)


def normalize(text: Column, dehyphenate: bool = False, compose: bool = True) -> Column:
    """NFKC, line ends, control characters, (words broken over lines,) blanks inside and at the end of lines, blank lines, in this order."""
    out = nfkc(text) if compose else text
    out = F.regexp_replace(out, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    if dehyphenate:
        out = F.regexp_replace(out, r"(?U)(\w)-\n([a-z])", "$1$2")
    out = F.regexp_replace(out, r"(?U)(?<=\S)[ \t]{2,}+(?=\S)", " ")
    out = F.regexp_replace(out, r"(?<![ \t])[ \t]+(?=\n|\z)", "")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, rf"\A{SPACE}+|(?<!{SPACE}){SPACE}+\z", "")


def dedupe_key(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(fold(sentence), r"\s+", " "))


SPANS = T.ArrayType(T.StructType([T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType()), T.StructField("sentence", T.StringType())]))
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


@F.pandas_udf(SPANS)
def sentence_spans(text: pd.Series, with_headings: pd.Series) -> pd.Series:
    """Sentences with their exact places, trimmed, none empty; where `with_headings` is true, # heading lines end a sentence and belong to none."""
    from lodestar.sources.files import headings

    def spans(text: str, marked: bool) -> list[dict]:
        # Sentences are what is left between the cuts: white space after their ends, and heading lines.
        cuts = [m.span() for m in _SENTENCE_END.finditer(text)]
        cuts += [(at, (text + "\n").index("\n", at)) for at, _, _ in headings(text)] if marked else []
        out, at = [], 0
        for cut, after in [*sorted(cuts), (len(text), len(text))]:
            words = text[at:cut]
            if inner := words.strip():
                first = at + words.index(inner)
                out.append({"start_char": first, "end_char": first + len(inner), "sentence": inner})
            at = max(at, after)
        return out

    return pd.Series([spans(t, bool(m)) if t is not None else None for t, m in zip(text, with_headings, strict=True)])


def sentences(text: Column) -> Column:
    """Array of sentences of plain text: cut after . ! ? and white space, trimmed, none empty."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def locate_quote(quote: Column, text: Column) -> Column:
    """0-based code-point offset of `quote` in `text`, exactly or with folded case where folding keeps both lengths; null if absent."""
    exact = F.position(quote, text)
    folds = (F.length(fold(quote)) == F.length(quote)) & (F.length(fold(text)) == F.length(text))
    loose = F.when(folds, F.position(fold(quote), fold(text)))
    return F.nullif(F.when(exact > 0, exact).otherwise(F.coalesce(loose, F.lit(0))), F.lit(0)) - 1


def reply_content(body: Column) -> Column:
    """The message of a chat service's response (JSON {choices: [{message: {content}}]}, maybe inside {data: ...}); null where it has none."""
    whole = F.try_parse_json(body)
    inner = F.coalesce(F.try_variant_get(whole, "$.data", "variant"), whole)
    found = F.try_variant_get(inner, "$.choices[0].message.content", "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string"))


def parse_reply(content: Column) -> Column:
    """A model's reply (JSON, maybe in a code fence or with words around it) as VARIANT; null if there is none."""
    fenced = F.regexp_extract(content, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(content)
    braces = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(F.trim(body)), F.try_parse_json(braces))
