"""Text features as column expressions; lexicons are parameters.

Everything stays in the JVM: regular expressions, higher-order functions, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def html_to_text(html: Column) -> Column:
    """Without scripts, styles, head, tags and entities, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style|head|meta)\b.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def first_image_url(html: Column) -> Column:
    """First absolute image source, else null."""
    found = F.regexp_extract(html, r"(?i)<img[^>]+src=[\"'](https?://[^\"']+)", 1)
    return F.nullif(found, F.lit(""))


def clean_text(text: Column) -> Column:
    """Three and more line ends become two, runs of blanks one, control characters go."""
    out = F.regexp_replace(text, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r" {2,}", " ")
    return F.trim(F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))


def split_joined(text: Column) -> Column:
    """A space between a lower and an upper letter, and after a full stop before an upper one."""
    return F.regexp_replace(F.regexp_replace(text, r"([a-z])([A-Z])", "$1 $2"), r"\.([A-Z])", ". $1")


def dollar_amounts(text: Column) -> Column:
    """Amounts in dollars: those in billions, in millions, then plain ones over 10,000."""

    def number(x: Column) -> Column:
        return F.replace(x, F.lit(","), F.lit("")).try_cast("double")

    billions = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\$\s*([\d,]+(?:\.\d+)?)\s*billion"), 1), lambda x: number(x) * 1e9)
    millions = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\$\s*([\d,]+(?:\.\d+)?)\s*million"), 1), lambda x: number(x) * 1e6)
    plain = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\$\s*([\d,]+(?:\.\d+)?)"), 1), number), lambda x: x > 10000)
    return F.filter(F.concat(billions, millions, plain), lambda x: x.isNotNull())


def percentages(text: Column) -> Column:
    """Percentages from -100 to 1000."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)\s*%"), 1), lambda x: x.try_cast("double"))
    return F.filter(found, lambda x: x.between(-100, 1000))


def scaled_match(text: Column, label: str) -> Column:
    """Absolute amount after a label, in units, by its million or billion."""
    pattern = rf"(?i){label}\D{{0,20}}\$([\d,]+(?:\.\d+)?)\s*(million|billion)"
    number = F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit("")).try_cast("double")
    return F.abs(number) * F.when(F.lower(F.regexp_extract(text, pattern, 2)) == "billion", 1e9).otherwise(1e6)


def parse_amount(text: Column) -> Column:
    """Magnitude of an accounting number such as ``$(1,505)``; null if there is none."""
    return F.abs(F.regexp_replace(F.translate(text, "−–—", "---"), r"[$,()\s]", "").try_cast("double"))


def unit_of(text: Column) -> Column:
    """Unit that a table header names: billions, millions, thousands or units."""
    low = F.lower(text)
    return F.when(low.contains("in billions"), "billions").when(low.contains("in millions"), "millions").when(low.contains("in thousands"), "thousands").otherwise("units")


def to_millions(value: Column, unit: Column) -> Column:
    return value * F.when(unit == "billions", 1e3).when(unit == "millions", 1.0).when(unit == "thousands", 1e-3).otherwise(1e-6)


def keyword_count(text: Column, words: list[str], whole: bool = False) -> Column:
    """Occurrences of any of the words, as substrings of the lower-cased text or as whole words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0)
    for w in words:
        hits = F.regexp_count(low, F.lit(rf"\b{w}\b")) if whole else (F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)
        total = total + hits.cast("int")
    return total


def lexicon_sentiment(text: Column, positive: list[str], negative: list[str], token: str = r"(?U)\w+") -> Column:
    """(positive - negative) / (positive + negative) over tokens; 0 without any."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(token), 0)
    pos, neg = F.size(F.filter(tokens, lambda x: x.isin(positive))), F.size(F.filter(tokens, lambda x: x.isin(negative)))
    return F.when(pos + neg > 0, (pos - neg) / (pos + neg)).otherwise(0.0)


def two_sided(text: Column, side_a: dict[str, list[str]], side_b: dict[str, list[str]]) -> tuple[Column, Column]:
    """(share of side a in percent, label); high words weigh 3, medium ones 1; 70 and 30 are the cuts."""
    a = keyword_count(text, side_a["high"]) * 3 + keyword_count(text, side_a["medium"])
    b = keyword_count(text, side_b["high"]) * 3 + keyword_count(text, side_b["medium"])
    share = F.when(a + b > 0, a * 100.0 / (a + b)).otherwise(50.0)
    return share, F.when(a + b == 0, "unclassified").when(share >= 70, "a").when(share <= 30, "b").otherwise("mixed")


def tags(title: Column, body: Column, categories: dict[str, list[str]]) -> Column:
    """Categories with a keyword in the title, or else in the body."""

    def of(text: Column) -> Column:
        padded = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))

        def any_word(words: list[str]) -> Column:
            out = F.lit(False)
            for w in words:
                out = out | padded.contains(w)
            return out

        return F.array_compact(F.array(*[F.when(any_word(ws), F.lit(name)) for name, ws in categories.items()]))

    return F.when(F.size(of(title)) > 0, of(title)).otherwise(of(body))


def canonical_url(url: Column) -> Column:
    """Scheme and host lower-cased, ``www.``, fragment and closing slash gone; the query stays."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    scheme, host = F.lower(F.regexp_extract(bare, r"^([A-Za-z][\w+.-]*)://", 1)), F.lower(F.regexp_extract(bare, r"^[^:]+://([^/?]*)", 1))
    path, query = F.regexp_extract(bare, r"^[^:]+://[^/?]*([^?]*)", 1), F.regexp_extract(bare, r"(\?.*)$", 1)
    return F.concat(scheme, F.lit("://"), F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""), query)


def root_domain(url: Column) -> Column:
    """Last two labels of the host."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[^:]+://([^/?#:]*)", 1)), r"^www\.", "")
    return F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)


def snippet(text: Column, word: str, before: int = 50, after: int = 100) -> Column:
    """Text around the first hit of a word; null without one."""
    at = F.instr(F.lower(text), word)
    return F.when(at > 0, F.substring(text, F.greatest(at - before, F.lit(1)), F.least(at - 1, F.lit(before)) + len(word) + after))


def first_sentence(text: Column, most: int = 180) -> Column:
    return F.substring(F.trim(F.regexp_extract(text, r"^([^.!?]*[.!?]?)", 1)), 1, most)


def query_terms(text: Column, stopwords: list[str]) -> Column:
    """Distinct words of three characters or more that are no stopwords."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]{3,}"), 0)
    return F.array_except(words, F.array(*[F.lit(w) for w in stopwords]).cast("array<string>"))


def truncate_words(text: Column, n: int) -> Column:
    """The first n words with their layout."""
    return F.regexp_extract(text, rf"^((?:\s*\S+){{1,{n}}})", 1)


def cascade(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Label of the first rule (label, pattern) that a text fits."""
    out = F.lit(default)
    for label, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out


def age_of(text: Column, as_of: Column) -> Column:
    """Timestamp of ``3 days ago`` and the like (months 30 days, years 365), else of the usual formats."""
    n, unit = F.regexp_extract(text, r"(?i)(\d+)\s+(\w+?)s?\s+ago", 1).try_cast("int"), F.lower(F.regexp_extract(text, r"(?i)\d+\s+(\w+?)s?\s+ago", 1))
    seconds = n * F.when(unit == "minute", 60).when(unit == "hour", 3600).when(unit == "day", 86400).when(unit == "week", 604800).when(unit == "month", 2592000).when(unit == "year", 31536000)
    relative = F.timestamp_seconds(F.unix_timestamp(as_of) - seconds)
    formats = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "MM/dd/yyyy"]
    return F.coalesce(relative, *[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def close_spaced(text: Column) -> Column:
    """Runs of three and more single letters between blanks become words: ``S t o c k``."""
    inside = r"(?<=\b[A-Za-z]) (?=[A-Za-z]\b)(?:(?<=\b[A-Za-z] [A-Za-z] )|(?=[A-Za-z] [A-Za-z]\b))"
    return F.regexp_replace(text, inside, "")


# Words that name a metric of a filing, before its amount.
METRIC_WORDS = {
    "revenue": "(?:total |net )?revenues?|net sales", "gross_profit": "gross profit", "operating_income": "operating income|income from operations", "net_income": "net income|net earnings",
    "capex": "capital expenditures?|capex", "free_cash_flow": "free cash flow", "total_assets": "total assets", "total_debt": "total debt|long-term debt", "research_development": "research and development|r&d",
}


def metrics(text: Column) -> dict[str, Column]:
    """The first amount after each metric's name, absolute and in units; null without one."""
    out = {}
    for name, words in METRIC_WORDS.items():
        pattern = rf"(?i)(?:{words})\D{{0,20}}\$\s*\(?([\d,]+(?:\.\d+)?)\)?\s*(million|billion)"
        number = F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit("")).try_cast("double")
        out[name] = number * F.when(F.lower(F.regexp_extract(text, pattern, 2)) == "billion", 1e9).otherwise(1e6)
    return out


def phrases_present(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases a text holds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((low.contains(p).cast("int") for p in phrases), F.lit(0))


def published(field: Column, title: Column, as_of: Column) -> Column:
    """``age_of`` the field, or its RFC 2822 form, else a date that the title names."""
    bare = F.regexp_replace(field, r"^[A-Za-z]{3}, | (?:GMT|UTC|[+]0000)$", "")
    named = F.regexp_extract(title, r"((?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4})", 1)
    return F.coalesce(age_of(field, as_of), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss")), F.try_to_timestamp(named, F.lit("MMMM d, yyyy")))


def expand(text: Column, synonyms: list[tuple[str, str]]) -> Column:
    """The text and, after it, the synonyms of every word that it holds."""
    return F.concat(text, *[F.when(F.lower(text).contains(w), F.lit(f" {more}")).otherwise("") for w, more in synonyms])


def truncate(text: Column, words: int, characters: int, least: int = 20) -> Column:
    """The first words, or of a text with ``least`` Chinese characters or more the first ``characters`` of these, with all between."""
    many = F.regexp_count(text, F.lit(r"\p{IsHan}")) >= least
    return F.when(many, F.regexp_extract(text, rf"^((?:[^\p{{IsHan}}]*\p{{IsHan}}){{1,{characters}}})", 1)).otherwise(truncate_words(text, words))
