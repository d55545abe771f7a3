"""Text, JSON and log expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Redaction rules in order, each with its pattern.
REDACTIONS = {
    "email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit-card": r"\b(?:\d[ -]*?){13,16}\b",
    "phone-us": r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "aws-access-key": r"\bAKIA[0-9A-Z]{16}\b",
    "bearer": r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{10,}",
    "sk-key": r"\bsk-[A-Za-z0-9_-]{10,}\b",
    "private-key-block": r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----[\s\S]*?-----END[^-]*-----",
}
#: What a text must hold for a rule to match at all: a part of it, or a pattern.
_NEEDS = {"email": "@", "aws-access-key": "AKIA", "sk-key": "sk-", "private-key-block": "-----BEGIN "}
_NEEDS_PATTERN = {
    "ssn": "[0-9]{3}-[0-9]{2}-[0-9]{4}", "credit-card": "[0-9](?:[ -]*[0-9]){12}", "phone-us": r"[0-9]{3}[-.\s]?[0-9]{4}", "ipv4": r"[0-9]\.[0-9]{1,3}\.[0-9]", "bearer": "(?i)bearer",
}
#: An edge between ASCII letters, digits and underscores and anything else; Java's own knows other letters too.
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: Phrases of empty prose by kind.
SLOP = {
    "filler": ["it is important to note", "in today's world", "needless to say", "at the end of the day"],
    "hedge": ["perhaps", "might be", "it seems", "arguably"],
    "apology": ["i apologize", "i'm sorry", "as an ai"],
}
#: Words too common to tell a domain.
STOP = ["the", "and", "that", "with", "for", "was", "this", "from", "are", "has", "have", "not", "you", "but", "und", "der", "die", "les", "que", "des", "est", "una", "los", "las"]


def error_signature(text: Column, span: Column | None = None) -> Column:
    """Ids, paths and numbers by their kinds, white space as one blank: what errors of one cause share.

    A null or blank message gives its span's name instead, or "error", and says so.
    """
    steps = [
        (r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<id>"), (r"(?i)\b[0-9a-f]{12,}\b", "<id>"),
        (r"(?:/[A-Za-z0-9_.@-]+){2,}", "<path>"), (r"(?i)\b[0-9]+(?:\.[0-9]+)?(ms|s|m|h|kb|mb|gb)?\b", "#$1"), (r"\s+", " "),
    ]
    name = F.lit("error") if span is None else F.when(span != "", span).otherwise("error")
    said = F.trim(F.coalesce(text, F.lit("")))
    base = F.when(said != "", said).otherwise(F.concat(F.lit("("), name, F.lit(" — no message)")))
    return F.trim(reduce(lambda t, s: F.regexp_replace(t, s[0].replace(r"\b", _EDGE), s[1]), steps, base))


def redact(rows: DataFrame, text: str, into: str, rules: dict[str, str] | None = None) -> DataFrame:
    """rows with `into`, the text after all rules in turn, and a count of replacements for each rule, named as the rule.

    Each rule runs once over what the ones ahead of it left, and only where its guard holds; what it put in
    is counted afterwards, less what stood there before.
    """
    rules, own, marks = rules or REDACTIONS, rows.columns, "_said"
    now = rows.withColumn(marks, F.col(text))
    for i, (name, pattern) in enumerate(rules.items()):
        needs = F.col(marks).contains(_NEEDS[name]) if name in _NEEDS else F.col(marks).rlike(_NEEDS_PATTERN[name]) if name in _NEEDS_PATTERN else F.lit(True)
        done = F.when(needs, F.regexp_replace(marks, pattern.replace(r"\b", _EDGE), f"[redacted:{name}]")).otherwise(F.col(marks))
        now = now.withColumn(f"_said{i}", done)
        marks = f"_said{i}"

    def count(name: str) -> Column:
        mark = f"[redacted:{name}]"
        times = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit(mark)))
        return ((times(marks) - times(text)) / len(mark)).cast("int").alias(name)

    return now.select(*own, F.col(marks).alias(into), *map(count, rules))


def slop_score(text: Column) -> Column:
    """10 less the phrases of SLOP (filler and apologies 1 each, hedges 0.5), within 0..10."""
    low, weight = F.lower(text), {"filler": 1.0, "hedge": 0.5, "apology": 1.0}
    hits = [weight[k] * (F.length(low) - F.length(F.replace(low, F.lit(p)))) / len(p) for k, ps in SLOP.items() for p in ps]
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), 10 - reduce(lambda a, b: a + b, hits)))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?]+\s+"), F.trim), lambda s: s != "")


def duplicate_share(text: Column) -> Column:
    """Share of a text's sentences that repeat an earlier one, by letters and digits alone."""
    keys = F.filter(F.transform(sentences(text), lambda s: F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " ")), lambda s: F.trim(s) != "")
    return F.coalesce(1 - F.try_divide(F.size(F.array_distinct(keys)).cast("double"), F.size(keys)), F.lit(0.0))


def domain_words(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z0-9_-]{3,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*STOP))


def asset_urls(html: Column, base: Column) -> Column:
    """Addresses of links and scripts, resolved against the page's own, each once, links first.

    Addresses with a scheme stay, `//` takes the page's scheme, `/` its host, others its folder. The last is
    not cleared of dots.
    """
    links = F.regexp_extract_all(html, F.lit(r"""(?i)<link\b[^>]*\bhref\s*=\s*["']([^"']+)["'][^>]*>"""), F.lit(1))
    scripts = F.regexp_extract_all(html, F.lit(r"""(?i)<script\b[^>]*\bsrc\s*=\s*["']([^"']+)["'][^>]*>"""), F.lit(1))
    scheme, host = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.when(F.regexp_replace(base, "[?#].*$", "").rlike("://[^/]*/"), F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "/[^/]*$", "/")).otherwise(F.concat(host, F.lit("/")))

    def whole(u: Column) -> Column:
        return F.when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), u).when(u.startswith("//"), F.concat(scheme, u)).when(u.startswith("/"), F.concat(host, u)).otherwise(F.concat(folder, u))

    return F.array_distinct(F.transform(F.concat(links, scripts), whole))


def has_element(html: Column, selector: str) -> Column:
    """Whether HTML has an element of a simple selector: tag, .class, #id or a tag with either."""
    tag, mark, name = selector.partition("#") if "#" in selector else selector.partition(".")
    attribute = {"#": "id", ".": "class", "": ""}[mark]
    inner = rf"""[^>]*\b{attribute}\s*=\s*["'](?:[^"']*\s)?{name}(?:\s[^"']*)?["']""" if attribute else r"(?:\s[^>]*)?"
    return html.rlike(rf"(?i)<{tag or '[a-z][a-z0-9]*'}{inner}[^>]*>")


def truncate(text: Column, limit: int, marker: str = "\n[truncated: original {} bytes]") -> Column:
    """At most `limit` bytes: a longer text keeps as many whole characters as fit ahead of a marker with its size.

    The cut is made at the text's share of the bytes that are left, or before it where that is too long.
    """
    size = F.octet_length(text)
    head, tail = (F.lit(x) for x in marker.split("{}"))
    note = F.concat(head, size.cast("string"), tail)
    room = limit - F.octet_length(note)
    share = F.greatest(F.lit(0), F.floor(F.length(text) * room / size)).cast("int")
    begun = F.length(F.substring(text.cast("binary"), F.lit(1), F.greatest(room, F.lit(0))).cast("string"))
    whole = begun - F.when(F.octet_length(F.substring(text, F.lit(1), begun)) > room, 1).otherwise(0)
    kept = F.substring(text, F.lit(1), F.greatest(F.lit(0), F.least(share, whole)))
    return F.when(size > limit, F.concat(kept, note)).otherwise(text)


def wire_id(text: Column, digits: int = 32) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def epoch_millis(text: Column) -> Column:
    """ISO time or epoch number as milliseconds; seconds, micro- and nanoseconds are told by size."""
    n = text.try_cast("decimal(20,0)")
    scaled = F.when(n < 100_000_000_000, n * 1000).when(n < 100_000_000_000_000, n).when(n < 100_000_000_000_000_000, n / 1000).otherwise(n / 1_000_000)
    return F.coalesce(scaled.cast("long"), F.unix_millis(F.try_to_timestamp(text)))


def test_counts(log: Column) -> Column:
    """passed and failed of a test run's log."""
    take = lambda word: F.coalesce(F.regexp_extract(log, rf"([0-9]+) {word}", 1).try_cast("int"), F.lit(0))
    return F.struct(take("passed").alias("passed"), take("failed").alias("failed"))


def patch_stats(diff: Column) -> Column:
    """files, added and removed of a unified diff."""
    lines = F.split(diff, "\n")
    count = lambda p: F.size(F.filter(lines, lambda l: l.rlike(p)))
    return F.struct(count(r"^\+\+\+ ").alias("files"), count(r"^\+(?!\+\+ )").alias("added"), count(r"^-(?!-- )").alias("removed"))


def model_family(model: Column) -> Column:
    """A model id without provider, date and version suffixes."""
    name = F.regexp_replace(F.lower(model), r"^.*/", "")
    return F.regexp_replace(F.regexp_replace(name, r"[-@:]?(20[0-9]{2}-?[0-9]{2}-?[0-9]{2}|latest|preview)$", ""), r"[-:]+$", "")


def has_snapshot(model: Column) -> Column:
    return model.rlike(r"20[0-9]{2}-?[0-9]{2}-?[0-9]{2}|@[0-9a-f]{6,}")


def hash_to_unit(text: Column, salt: str = "") -> Column:
    """A stable number in [0, 1) for splits, from SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat(text, F.lit(salt)), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)
