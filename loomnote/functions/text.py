"""Text functions on columns, all JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order, repeats kept; empty for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def lexical_terms(text: Column) -> Column:
    """Tokens of a query without stopwords."""
    return F.filter(tokens(text), lambda x: ~x.isin(params.STOPWORDS))


#: What every secret shape holds: texts without it are not looked at rule by rule.
SECRET_HINT = r"(?i)-----BEGIN|API[_-]?KEY|TOKEN|SECRET|PASSWORD|AIza|gh[posru]_|xox[baprs]-|A(?:KIA|SIA|GPA|ROA|IDA|NPA|NVA|IPA|BIA|CCA)[0-9A-Z]|Bearer|sk-"


def redact(text: Column) -> Column:
    """Secrets replaced by shape, keeping the key before them; idempotent, for a value that is redacted keeps its form."""
    return F.when(text.rlike(SECRET_HINT), reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), params.SECRET_RULES, text)).otherwise(text)


def secret_count(text: Column) -> Column:
    """Matches of the secret shapes, one rule after the other on the text as it was."""
    return F.when(text.rlike(SECRET_HINT), reduce(lambda a, rule: a + F.regexp_count(text, F.lit(rule[0])), params.SECRET_RULES, F.lit(0))).when(text.isNotNull(), 0)


def slug(text: Column) -> Column:
    """kebab-case of letters a-z and digits."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def entity_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z0-9]", "")


def body_key(text: Column) -> Column:
    """SHA-256 of a body in lower case with white space collapsed and trimmed."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), 256)


def snippet(text: Column, most: int = 240) -> Column:
    """The first line that is not blank, trimmed, at most so many characters."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.substring(F.get(lines, 0), 1, most)


def bigrams(text: Column) -> Column:
    n = F.length(text)
    return F.when(n < 2, F.array(text)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, 2))))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def similarity(a: Column, b: Column) -> Column:
    """The larger of edit similarity and bigram Jaccard."""
    edit = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.greatest(edit, jaccard(bigrams(a), bigrams(b)))


# What is no word for title matching: single letters, numbers and stopwords.
_NO_SCORING_WORD = rf"(?<![a-z0-9])(?:[a-z0-9]|[0-9]++|{'|'.join(params.TITLE_STOPWORDS)})(?![a-z0-9])"


def scoring_phrase(text: Column) -> Column:
    """Tokens for title matching in order, joined by blanks: a-z and digits, longer than one, no stopwords, no numbers."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), _NO_SCORING_WORD, ""), r"[^a-z0-9]+", " "))


def scoring_list(text: Column) -> Column:
    """The tokens of scoring_phrase."""
    return F.filter(F.split(scoring_phrase(text), " "), lambda x: x != "")


def scoring_tokens(text: Column) -> Column:
    return F.array_distinct(scoring_list(text))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def truncate_to_tokens(text: Column, most: int = 30_000) -> Column:
    """At most 4 * most characters, back to the last space if that keeps over nine tenths."""
    head = F.substring(text, 1, most * 4)
    kept = F.length(head) - F.locate(" ", F.reverse(head))
    return F.when(F.length(text) <= most * 4, text).when((F.locate(" ", F.reverse(head)) > 0) & (kept > most * 4 * 0.9), head.substr(F.lit(1), kept)).otherwise(head)


def uuid7_time(text: Column) -> Column:
    """Timestamp in a version-7 UUID, null for other strings."""
    plain = F.regexp_replace(F.lower(text), "-", "")
    return F.when(plain.rlike("^[0-9a-f]{12}7[0-9a-f]{19}$"), F.timestamp_millis(F.conv(F.substring(plain, 1, 12), 16, 10).cast("long")))


def excerpt(text: Column, most: int = 240) -> Column:
    """Text in one line, cut to ``most`` characters with a mark at the end if it is longer."""
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(line) > most, F.concat(F.rtrim(F.substring(line, 1, most - 1)), F.lit("\u2026"))).otherwise(line)


def path_day(path: Column) -> Column:
    """The day that a path names (YYYY-MM-DD after a slash or at its beginning), null if none."""
    found = F.regexp_extract(path, r"(?:^|/)(\d{4}-\d{2}-\d{2})(?=[^0-9]|$)", 1)
    return F.try_to_date(F.when(found != "", found))


def glob_pattern(glob: str) -> str:
    """The regular expression of a glob: ** is anything, * anything within a step, ? one sign; sets in brackets stay."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        c = glob[i]
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else c if c in "[]+-/" or c.isalnum() else "\\" + c
        i += 1
    return f"^{out}$"


def redact_config(config: Column) -> Column:
    """A map with the values under secret-looking keys hidden."""
    return F.transform_values(config, lambda k, v: F.when(F.lower(k).rlike(r"api[_-]?key|token|secret|password|credential"), "[REDACTED]").otherwise(v))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with each {{key}} replaced; keys without a value stay."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{{" + kv[0] + "}}"), F.coalesce(kv[1], F.lit(""))), values.items(), template)
