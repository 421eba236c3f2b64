"""Column expressions on identifiers, prompts and words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The pattern of a fenced block (optional sql tag), and the
# characters per token of the estimate.
FENCED_BLOCK = r"(?is)```(?:sql)?\s*(.*?)```"
CHARS_PER_TOKEN = 4

# English stop words of PostgreSQL's text search, in its order.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while of "
    "at by for with about against between into through during before after above below to from up down in out on "
    "off over under again further then once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don should now"
).split()

WORD_BREAK = r"[^\p{L}\p{N}]+"


def quote_identifier(name: Column) -> Column:
    """Quote all but plain lower-case identifiers: letters, digits and underscores."""
    plain = name.rlike(r"^(?=.*\p{Ll})[\p{Ll}\p{Lo}\p{N}_]+$")
    return F.when(plain, name).otherwise(F.concat(F.lit('"'), name, F.lit('"')))


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("int")


def _strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def extract_sql(completion: Column) -> Column:
    """The query in a model's answer: the first fenced block, or all of it."""
    fenced = F.regexp_extract(completion, FENCED_BLOCK, 1)
    body = F.when(completion.rlike(FENCED_BLOCK), fenced).otherwise(completion)
    return _strip(F.regexp_replace(_strip(body), ";+$", ""))


def stem(word: Column) -> Column:
    """Plural endings removed by the three rules of the S stemmer (Harman 1991)."""
    def ends(suffix: str, *unless: str) -> Column:
        found = word.endswith(suffix)
        for longer in unless:
            found = found & ~word.endswith(longer)
        return found

    length = F.length(word)
    return (
        F.when(ends("ies", "eies", "aies"), F.concat(F.substring(word, F.lit(1), length - 3), F.lit("y")))
        .when(ends("es", "aes", "ees", "oes") | ends("s", "us", "ss"), F.substring(word, F.lit(1), length - 1))
        .otherwise(word)
    )


def words(text: Column) -> Column:
    """Lower-case words of a text, as an array; empty strings at the ends are possible."""
    return F.split(F.lower(text), WORD_BREAK)
