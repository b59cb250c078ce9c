"""Text functions: words, features of entries and mails, small parsers. All are columns of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the item cleaner drops.
FILLER_WORDS = ["a", "new", "some", "more", "my", "own", "the", "many", "other", "another"]


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def strip_tags(html: Column, spaced: bool = False) -> Column:
    """Text without tags. `spaced` puts a space for each tag and stray `>`, and drops an unfinished tag."""
    if not spaced:
        return F.regexp_replace(html, "<[^>]+>", "")
    return F.regexp_replace(F.regexp_replace(html, "<[^>]*>|>", " "), "<[^>]*$", "")


def page_text(html: Column, keep_scripts: bool = False) -> Column:
    """Text nodes of a page, one a line, trimmed; the bodies of scripts and styles only if kept."""
    body = html if keep_scripts else F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1\\s*>", "")
    text = F.regexp_replace(F.regexp_replace(body, "(?s)<!--.*?-->", "\n"), "<[^>]*>", "\n")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda t: F.trim(t)), lambda t: t != ""), "\n")


def _words(text: Column, separators: str) -> Column:
    return F.transform(F.filter(F.split(text, separators), lambda w: w != ""), lambda w: F.lower(w))


def words_alpha(text: Column) -> Column:
    """Lowered words of letters; the caret counts as a letter."""
    return _words(text, "[^A-Z^a-z]+")


def words_all(text: Column) -> Column:
    """Lowered words of ASCII letters, digits and underscores."""
    return _words(text, "\\W+")


def words_len(text: Column) -> Column:
    """P5: words of 3 to 19 characters, each once."""
    return F.array_distinct(F.filter(words_all(text), lambda w: (F.length(w) > 2) & (F.length(w) < 20)))


def words_gt3(text: Column) -> Column:
    """Words of more than 3 characters, repeats kept."""
    return F.filter(words_all(text), lambda w: F.length(w) > 3)


def clean_item(name: Column) -> Column:
    """An item's name lowered, without characters from ! to . and without filler words; null under 2 characters."""
    kept = F.filter(F.split(F.trim(F.regexp_replace(F.lower(name), "[!-.]", "")), " "), lambda w: (w != "") & ~w.isin(FILLER_WORDS))
    joined = F.array_join(kept, " ")
    return F.when(F.length(joined) >= 2, joined)


def ngrams(words: Column, n: int) -> Column:
    """Joined runs of n words; none for fewer."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def entry_features(title: Column, summary: Column, publisher: Column, multi: int = 2, compat: bool = False) -> Column:
    """Features of an entry: title words, words of the summary, runs of `multi` words, publisher and flags.

    Flags: EXCLENGTH over 250 characters, UPPERCASE over 30 % words in capitals, PREPOFLONGWORDS over 30 % words of
    more than 16 characters; an empty summary has none. `compat` keeps what was literally done: runs of one word
    less, and capitals looked for after lowering, so never found."""
    title, summary = F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit(""))
    raw_words = F.filter(F.split(summary, "\\W+"), lambda w: (F.length(w) > 2) & (F.length(w) < 20))
    titles = F.transform(words_len(title), lambda w: F.concat(F.lit("Title:"), w))
    by = F.when(publisher.isNotNull(), F.array(F.concat(F.lit("Publisher:"), publisher))).otherwise(F.array().cast("array<string>"))

    def of(raw: Column, low: Column) -> Column:
        n = F.size(raw)
        capitals = F.size(F.filter(low if compat else raw, lambda w: (w == F.upper(w)) & (w != F.lower(w))))
        long_words = F.size(F.filter(raw, lambda w: F.length(w) > 16))
        flags = F.array(
            F.when(F.length(summary) > 250, F.lit("EXCLENGTH")),
            F.when((n > 0) & (capitals * 10 > n * 3), F.lit("UPPERCASE")),
            F.when((n > 0) & (long_words * 10 > n * 3), F.lit("PREPOFLONGWORDS")),
        )
        runs = ngrams(low, max(1, multi - 1) if compat else multi)
        return F.concat(titles, low, runs, by, F.filter(flags, lambda x: x.isNotNull()))

    return F.array_distinct(let(raw_words, lambda raw: let(F.transform(raw, lambda w: F.lower(w)), lambda low: of(raw, low))))


def mail_features(sender: Column, subject: Column, body: Column, ip: Column, compat: bool = False) -> Column:
    """Features of a mail: words of sender and subject with a prefix, the address, words and pairs of the body,
    and UPPERCASE. `compat` takes one word for a pair, as was literally done."""
    words = F.filter(F.split(F.coalesce(body, F.lit("")), "\\W+"), lambda w: (F.length(w) > 2) & (F.length(w) < 20))
    first = F.transform(words_len(F.coalesce(sender, F.lit(""))), lambda w: F.concat(F.lit("From:"), w))
    second = F.transform(words_len(F.coalesce(subject, F.lit(""))), lambda w: F.concat(F.lit("Subject:"), w))
    at = F.when(ip.isNotNull(), F.array(F.concat(F.lit("Ip"), ip))).otherwise(F.array().cast("array<string>"))

    def of(raw: Column, low: Column) -> Column:
        capitals = F.size(F.filter(raw, lambda w: (w == F.upper(w)) & (w != F.lower(w))))
        flag = F.when((F.size(raw) > 0) & (capitals * 10 > F.size(raw) * 3), F.array(F.lit("UPPERCASE"))).otherwise(F.array().cast("array<string>"))
        return F.concat(first, second, at, low, ngrams(low, 1 if compat else 2), flag)

    return F.array_distinct(let(words, lambda raw: let(F.transform(raw, lambda w: F.lower(w)), lambda low: of(raw, low))))


def minutes(time: Column) -> Column:
    """H:MM as minutes."""
    parts = F.split(time, ":")
    return F.try_add(parts[0].try_cast("int") * 60, parts[1].try_cast("int"))


def parse_price(price: Column) -> Column:
    """A price without its currency sign and commas."""
    return F.replace(F.substr(price, F.lit(2)), F.lit(","), F.lit("")).try_cast("double")


def yesno(value: Column) -> Column:
    """Yes 1, no -1, anything else 0."""
    return F.when(value == "yes", 1).when(value == "no", -1).otherwise(0)


def match_count(a: Column, b: Column) -> Column:
    """How many values of one colon list, repeats counted, are in another."""
    return F.size(F.filter(F.split(a, ":"), lambda v: F.array_contains(F.split(b, ":"), v)))
