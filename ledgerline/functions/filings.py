"""Filing names, sections, tables and passages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Section headers of filings (pattern on an upper-cased line, name, level), first match wins.
SECTIONS = [
    (r"^ITEM\s*1\.?\s*BUSINESS", "Item 1. Business", 1),
    (r"^ITEM\s*1A\.?\s*RISK\s*FACTORS", "Item 1A. Risk Factors", 1),
    (r"^ITEM\s*2\.?\s*PROPERTIES", "Item 2. Properties", 1),
    (r"^ITEM\s*7\.?\s*MANAGEMENT", "Item 7. MD&A", 1),
    (r"^ITEM\s*7A\.?\s*QUANTITATIVE", "Item 7A. Market Risk", 1),
    (r"^ITEM\s*8\.?\s*FINANCIAL\s*STATEMENTS", "Item 8. Financial Statements", 1),
    (r"CONSOLIDATED\s*STATEMENTS?\s*OF\s*OPERATIONS", "Income Statement", 2),
    (r"CONSOLIDATED\s*STATEMENTS?\s*OF\s*CASH\s*FLOWS?", "Cash Flow Statement", 2),
    (r"CONSOLIDATED\s*BALANCE\s*SHEETS?", "Balance Sheet", 2),
    (r"CONSOLIDATED\s*STATEMENTS?\s*OF\s*COMPREHENSIVE", "Comprehensive Income", 2),
    (r"LIQUIDITY\s*AND\s*CAPITAL\s*RESOURCES", "Liquidity and Capital Resources", 3),
    (r"CAPITAL\s*EXPENDITURES?", "Capital Expenditures", 3),
    (r"RESULTS\s*OF\s*OPERATIONS", "Results of Operations", 3),
    (r"CRITICAL\s*ACCOUNTING", "Critical Accounting Policies", 3),
]
# Words of a filing's first 5000 characters that tell its type, two of which are needed.
ANNUAL = [r"ANNUAL\s*REPORT", r"FORM\s*10-K", r"FORM\s*20-F", r"pursuant\s*to\s*section\s*13\s*or\s*15\(d\)", r"fiscal\s*year\s*ended", r"annual\s*report\s*on\s*form\s*10-k", r"annual\s*report\s*on\s*form\s*20-f"]
QUARTERLY = [r"QUARTERLY\s*REPORT", r"FORM\s*10-Q", r"FORM\s*6-K", r"quarterly\s*report\s*on\s*form\s*10-q", r"quarter\s*ended", r"quarterly\s*period\s*ended", r"report\s*of\s*foreign\s*private\s*issuer"]
# Rules on file names, in order.
NAME_RULES = [(r"20-?f", "10-K"), (r"6-?k", "10-Q"), (r"^10-k|10k", "10-K"), (r"^10-q|10q", "10-Q"), (r"^8-k|8k", "8-K"), (r"annual.*report|report.*annual", "10-K")]
# Exhibits that are press releases.
PRESS_EXHIBITS = ["EX-99.1", "EX-99.2", "EX-99"]
# Kinds of site by words around a place name, first match wins.
SITE_WORDS = [
    ("Manufacturing", r"manufactur|production\s+facilit|assembly\s+plant|factory|plant"),
    ("Design Center", r"design\s+center|engineering\s+center|r&d\s+center|research\s+and\s+development|innovation\s+center"),
    ("Headquarters", r"headquarters|corporate\s+office|principal\s+executive\s+office|head\s+office"),
    ("Data Center", r"data\s+center|cloud\s+infrastructure|server\s+facility"),
    ("Distribution", r"distribution\s+center|logistics\s+center|warehouse"),
]
# Words that open an investment signal, by family, and guesses of its type.
SIGNALS = [
    ("amount_mentioned", r"\$[\d,]+\s*(million|billion|thousand|m|b|k)|[\d,]+\s*(million|billion)\s*dollars|capex\s+of\s+\$?[\d,]+"),
    ("capex", r"capital expenditure|capex|capital spending|property and equipment|pp&e|property, plant"),
    ("action", r"building|expanding|acquiring|opening|launching|invest|constructing|construct"),
    ("capacity", r"new facility|production line|manufacturing capacity|factory|campus|site expansion|new plant"),
]
SIGNAL_TYPES = [
    ("FACILITY_OPEN_EXPAND", r"facility|factory|plant"), ("M_AND_A", r"acqui|merger"), ("CAPEX_GUIDANCE", r"capex|capital expenditure"),
    ("DATA_CENTER_CAPACITY", r"data center|hyperscale"), ("EQUIPMENT_PURCHASE", r"equipment"),
]


def first_match(text: Column, rules: list, default: Column) -> Column:
    """Value of the first rule (pattern, value, ...) that a text fits."""
    out = default
    for pattern, value, *_ in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(value)).otherwise(out)
    return out


def filing_type(name: Column, content: Column) -> Column:
    """10-K, 10-Q, 8-K or Other: by the file's name, else by two or more marks in its beginning (ties: annual)."""
    head = F.substring(F.coalesce(content, F.lit("")), 1, 5000)
    score = lambda patterns: sum((head.rlike(f"(?i){p}").cast("int") for p in patterns), F.lit(0))
    a, q = score(ANNUAL), score(QUARTERLY)
    by_content = F.when((a >= 2) & (a >= q), "10-K").when(q >= 2, "10-Q").otherwise("Other")
    return first_match(F.lower(name), NAME_RULES, by_content)


def exhibit_kind(name: Column, kind: Column) -> Column:
    """Earnings Transcript by name, Press Release by exhibit number, else null."""
    return F.when(F.lower(name).contains("transcript"), "Earnings Transcript").when(kind.isin(PRESS_EXHIBITS), "Press Release")


def section_of(context: Column, default: str = "Financial Tables") -> Column:
    """Section whose pattern a table's context fits."""
    return first_match(F.upper(F.coalesce(context, F.lit(""))), SECTIONS, F.lit(default))


def table_name(context: Column) -> Column:
    """A statement, schedule or note that a context names, else its first 50 characters."""
    low = F.lower(context)
    found = [F.nullif(F.regexp_extract(low, p, 0), F.lit("")) for p in (r"(?:consolidated\s+)?statements?\s+of\s+[\w\s]+", r"(?:schedule|table)\s+[\w\s]+", r"note\s+\d+[\w\s]*")]
    return F.when(F.coalesce(context, F.lit("")) == "", "Unnamed Table").otherwise(F.coalesce(*[F.initcap(x) for x in found], F.trim(F.substring(context, 1, 50))))


# Patterns of file names with their groups of year and quarter, in order of precedence; then a month and a
# year, a date, a quarter before its year; and what a content says of a year that has ended.
NAME_FAMILIES = [(r"[Ff][Yy](\d{2,4})[_\-]?[Qq](\d)", 1, 2), (r"[Qq](\d)[_\-]?[Ff][Yy](\d{2,4})", 2, 1), (r"(\d{4}).*[Qq](\d)", 1, 2), (r"(\d{2})[Qq](\d)", 1, 2)]
MONTH_YEAR, DATED, QUARTER_FIRST = r"(?:8[Kk]|10[Kk]|10[Qq])_(\d{2})(\d{2})", r"(\d{4})-(\d{2})-(\d{2})", r"[Qq](\d)[_\-](\d{4})"
YEARS_ENDED = [
    r"(?is)fiscal\s*year\s*ended\s*.*?(20\d{2})",
    r"(?i)year\s*ended\s*(?:january|february|march|april|may|june|july|august|september|october|november|december)\s*\d{1,2}\s*,?\s*(20\d{2})",
    r"(?is)for\s*the\s*year\s*ended\s*.*?(20\d{2})",
    r"(?is)quarterly\s*(?:report|period)\s*ended\s*.*?(20\d{2})",
]
#: Quarter of a fiscal year that ends in March, by the month in which its report is filed.
FILED_IN = {7: 1, 8: 1, 10: 2, 11: 2, 1: 3, 2: 3, 5: 4, 6: 4}


def fiscal_name(name: Column, content: Column, company: Column | None = None, filed: tuple[str, ...] = (), period_end: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """(``FYyy``, ``Qn``) of a file's name, else of its content; Unknown and an empty quarter without one.

    In this order: FY22Q3, Q3-FY26, 2023...Q2, 25Q2, 8K_0824 (month and year, years that begin in
    February), a date, Q1-2025; then a year that the content says has ended. What a date means
    depends on the company: those of ``filed`` have fiscal years that end in March and name the
    day of filing, those of ``period_end`` calendar years and the day that ends the period; for
    all others a date says nothing.
    """
    part = lambda p, i: F.regexp_extract(name, p, i)
    month = part(MONTH_YEAR, 1).try_cast("int")
    shifted = F.floor(F.pmod(month - 2, F.lit(12)) / 3).cast("int") + 1
    one_of = lambda names: F.coalesce(company.isin(*names), F.lit(False)) if company is not None and names else F.lit(False)
    y, m = part(DATED, 1).try_cast("int"), part(DATED, 2).try_cast("int")
    filing = F.create_map(*[F.lit(x) for pair in FILED_IN.items() for x in pair])
    head = F.substring(F.coalesce(content, F.lit("")), 1, 10000)
    ended = F.coalesce(*[F.nullif(F.regexp_extract(head, p, 1), F.lit("")) for p in YEARS_ENDED])
    year, quarter = F.when(ended.isNotNull(), F.right(ended, F.lit(2))), F.lit(None).cast("string")
    for has, of_year, of_quarter in [
        (name.rlike(QUARTER_FIRST), part(QUARTER_FIRST, 2), part(QUARTER_FIRST, 1)),
        (name.rlike(DATED) & one_of(period_end), part(DATED, 1), F.when(m.between(1, 12), F.ceil(m / 3).cast("string")).otherwise("")),
        (name.rlike(DATED) & one_of(filed), (y + F.when(m >= 4, 1).otherwise(0)).cast("string"), F.coalesce(F.try_element_at(filing, m).cast("string"), F.lit(""))),
        (name.rlike(MONTH_YEAR), part(MONTH_YEAR, 2), F.when(month.between(1, 12), shifted.cast("string")).otherwise("")),
        *[(name.rlike(p), part(p, i), part(p, j)) for p, i, j in reversed(NAME_FAMILIES)],
    ]:
        year, quarter = F.when(has, F.right(of_year, F.lit(2))).otherwise(year), F.when(has, of_quarter).otherwise(quarter)
    return F.coalesce(F.concat(F.lit("FY"), year), F.lit("Unknown")), F.when(F.coalesce(quarter, F.lit("")) != "", F.concat(F.lit("Q"), quarter)).otherwise("")


def signal(text: Column) -> tuple[Column, Column, Column]:
    """(families of triggers, guessed type, confidence) of a passage."""
    low = F.lower(F.coalesce(text, F.lit("")))
    families = F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(name)) for name, p in SIGNALS]))
    kind = first_match(low, [(p, name) for name, p in SIGNAL_TYPES], F.lit("UNKNOWN"))
    return families, kind, F.when(F.size(families) >= 2, 0.8).otherwise(0.5)


def site_kind(context: Column) -> Column:
    """Kind of site by the words around a place name; Manufacturing without any."""
    return first_match(F.lower(context), [(p, name) for name, p in SITE_WORDS], F.lit("Manufacturing"))


def places(text: Column, pattern: Column, size: Column) -> Column:
    """Positions (from 1) of all hits of a pattern whose hits have ``size`` characters."""
    parts = F.split(text, pattern)
    zero = F.struct(F.array().cast("array<int>").alias("out"), F.lit(1).alias("at"))
    step = lambda acc, p: F.struct(F.array_append(acc["out"], acc["at"] + F.length(p)).alias("out"), (acc["at"] + F.length(p) + size.cast("int")).alias("at"))
    return F.aggregate(F.slice(parts, 1, F.size(parts) - 1), zero, step, lambda acc: acc["out"])
