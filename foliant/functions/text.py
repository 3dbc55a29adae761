"""Text, number and date expressions; all are columns over columns and stay inside generated code or the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize(text: Column) -> Column:
    """Unicode white space single and none at the ends; null becomes empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def canonical(text: Column) -> Column:
    """normalize(), case folded."""
    return F.replace(F.lower(normalize(text)), F.lit("ß"), F.lit("ss"))


def margin_key(text: Column) -> Column:
    """Text of a header or footer with its numbers made equal."""
    return F.regexp_replace(canonical(text), r"(?U)\d+", "#")


def contains_any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def count_contained(text: Column, words) -> Column:
    """How many of the words the text contains."""
    out = F.lit(0)
    for w in words:
        out = out + text.contains(w).cast("int")
    return out


def rounded(x: Column, digits: int) -> Column:
    """Rounded half to even on the exact binary value."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits)).cast("double")


def rounded_away(x: Column, digits: int) -> Column:
    """Rounded half away from zero after scaling, as SQL's round()."""
    scale = float(10**digits)
    return let(F.abs(x) * scale, lambda s: F.when(s - F.rint(s) >= 0.5, F.rint(s) + 1).otherwise(F.rint(s))) * F.signum(x) / scale


def rounded_even(x: Column, digits: int) -> Column:
    """Rounded half to even after scaling, as SQL's round_even(); rounded() takes 49.995, which is a little less, to 49.99, and this to 50."""
    return F.rint(x * float(10**digits)) / float(10**digits)


def money_value(token: Column) -> Column:
    """The number of one money token, or null."""
    bare = F.regexp_replace(F.regexp_replace(normalize(token), r"(?i)^(USD|CNY|RMB)", ""), r"(?U)[$€£¥,\s]", "")
    return rounded(bare.try_cast("double"), 2)


def money_tokens(text: Column) -> Column:
    # most lines have no digit, which a short search tells
    return F.when(text.rlike(r"(?U)\d"), F.regexp_extract_all(text, F.lit(vocab.MONEY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def money_values(text: Column) -> Column:
    return F.filter(F.transform(money_tokens(text), money_value), lambda v: v.isNotNull())


def last_money(text: Column) -> Column:
    return F.try_element_at(money_values(text), F.lit(-1))


def number_cell(cell: Column) -> Column:
    """A cell's last money value, else the whole cell as a number, else null."""
    text = normalize(cell)
    return F.coalesce(last_money(text), rounded(F.replace(text, F.lit(","), F.lit("")).try_cast("double"), 2))


def iso_date(text: Column) -> Column:
    """The first date as YYYY-MM-DD, year first before month first; months and days are only checked for range; else null."""

    def read(t, pattern, y, m, d):
        """The pattern's first match, which holds three numbers, as a date."""

        def dated(numbers):
            part = lambda i: F.get(numbers, F.lit(i))
            ok = part(m).try_cast("int").between(1, 12) & part(d).try_cast("int").between(1, 31)
            return F.when(ok, F.concat(F.lpad(part(y), 4, "0"), F.lit("-"), F.lpad(part(m), 2, "0"), F.lit("-"), F.lpad(part(d), 2, "0")))

        return let(F.regexp_extract_all(F.regexp_extract(t, pattern, 0), F.lit(r"(?U)\d+"), F.lit(0)), dated)

    # most lines have no year, which a short search tells
    return F.when(text.rlike(r"(?U)\d{4}"), let(normalize(text), lambda t: F.coalesce(read(t, vocab.DATE_YMD, 0, 1, 2), read(t, vocab.DATE_MDY, 2, 0, 1))))


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def currency(text: Column) -> Column:
    """USD, CNY, EUR or GBP by sign or code, or empty."""
    low = F.lower(text)
    return F.when(low.contains("$") | low.contains("usd"), "USD").when(contains_any(low, ("¥", "cny", "rmb", "人民币")), "CNY").when(low.contains("€") | low.contains("eur"), "EUR").when(low.contains("£") | low.contains("gbp"), "GBP").otherwise("")


def compact(text: Column, most: int) -> Column:
    """normalize(), cut to `most` characters with an ellipsis."""
    t = normalize(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…")))


def tokens(text: Column, stopwords) -> Column:
    """Distinct search tokens: words of two ASCII letters or digits and more, runs of CJK, pairs of CJK; no stop words."""
    t = canonical(text)
    words = F.regexp_extract_all(t, F.lit(r"[a-z0-9][a-z0-9_-]{1,}|[一-鿿]{2,}"), F.lit(0))
    han = F.regexp_extract_all(t, F.lit(r"[一-鿿]"), F.lit(0))
    pairs = F.transform(F.slice(han, 1, F.greatest(F.size(han) - 1, F.lit(0))), lambda c, i: F.concat(c, F.get(han, i + 1)))
    return F.array_except(F.array_distinct(F.concat(words, pairs)), F.array(*map(F.lit, stopwords)))


def joined(parts) -> str:
    """Plain texts as one: a hyphen before a small letter is taken off, else a space comes between."""
    out = ""
    for t in parts:
        out = t if not out else out[:-1] + t if out.endswith("-") and t[:1].islower() else f"{out} {t}"
    return out
