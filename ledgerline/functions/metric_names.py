"""Names under which questions ask for a metric."""

from __future__ import annotations

# Field, statement, label, and the names that stand for the field, in order of precedence among equally long ones.
METRICS: list[tuple[str, str, str, list[str]]] = [
    ("Total Revenue", "income", "Total Revenue", ["total revenue", "net revenue", "net sales", "operating revenue", "revenue", "sales", "turnover", "top line", "topline", "营收", "收入"]),
    ("Cost Of Revenue", "income", "Cost of Revenue", ["cost of revenue", "cost of goods sold", "cost of sales", "cogs", "成本"]),
    ("Gross Profit", "income", "Gross Profit", ["gross profit", "gross income", "gross margin", "毛利"]),
    ("Operating Income", "income", "Operating Income", ["operating income", "operating profit", "income from operations", "营业利润"]),
    ("Operating Expense", "income", "Operating Expense", ["operating expense", "operating expenses", "opex"]),
    ("Selling General And Administration", "income", "SG&A", ["selling general and administration", "selling general administrative", "sg&a", "sga", "selling and administrative"]),
    ("EBITDA", "income", "EBITDA", ["ebitda", "earnings before interest taxes depreciation and amortization"]),
    ("EBIT", "income", "EBIT", ["ebit", "earnings before interest and tax"]),
    ("Pretax Income", "income", "Pretax Income", ["pretax income", "pre-tax income", "income before tax", "ebt", "earnings before tax"]),
    ("Tax Provision", "income", "Income Tax", ["tax provision", "income tax", "income taxes", "tax expense"]),
    ("Interest Expense", "income", "Interest Expense", ["interest expense"]),
    ("Interest Income", "income", "Interest Income", ["interest income"]),
    ("Net Income", "income", "Net Income", ["net income", "net profit", "net earnings", "bottom line", "bottomline", "净利润"]),
    ("Diluted EPS", "income", "Diluted EPS", ["diluted earnings per share", "diluted eps"]),
    ("Basic EPS", "income", "Basic EPS", ["basic earnings per share", "basic eps"]),
    ("Diluted EPS", "income", "Diluted EPS", ["earnings per share", "eps", "每股收益"]),
    ("Free Cash Flow", "cashflow", "Free Cash Flow", ["free cash flow", "fcf", "自由现金流"]),
    ("Operating Cash Flow", "cashflow", "Operating Cash Flow", ["operating cash flow", "cash from operations", "cash flow from operations", "ocf", "cfo", "经营现金流"]),
    ("Investing Cash Flow", "cashflow", "Investing Cash Flow", ["investing cash flow", "cash flow from investing", "cfi"]),
    ("Financing Cash Flow", "cashflow", "Financing Cash Flow", ["financing cash flow", "cash flow from financing", "cff"]),
    ("Operating Cash Flow", "cashflow", "Operating Cash Flow", ["cash flow", "现金流"]),
    ("Capital Expenditure", "cashflow", "Capital Expenditure", ["capital expenditures", "capital expenditure", "capital spending", "capital spend", "capital investment", "capex", "资本支出"]),
    ("Depreciation And Amortization", "cashflow", "Depreciation & Amortization", ["depreciation and amortization", "depreciation & amortization", "d&a"]),
    ("Depreciation", "cashflow", "Depreciation", ["depreciation"]),
    ("Amortization", "cashflow", "Amortization", ["amortization"]),
    ("Repurchase Of Capital Stock", "cashflow", "Share Repurchases", ["share repurchase", "stock repurchase", "stock buyback", "share buyback", "buybacks", "buyback"]),
    ("Issuance Of Debt", "cashflow", "Debt Issuance", ["debt issuance", "issuance of debt"]),
    ("Repayment Of Debt", "cashflow", "Debt Repayment", ["debt repayment", "repayment of debt"]),
    ("End Cash Position", "cashflow", "Ending Cash Position", ["end cash position", "ending cash position", "ending cash balance"]),
    ("Total Assets", "balance", "Total Assets", ["total assets", "总资产"]),
    ("Total Liabilities Net Minority Interest", "balance", "Total Liabilities", ["total liabilities"]),
    ("Net Debt", "balance", "Net Debt", ["net debt", "净债务"]),
    ("Total Debt", "balance", "Total Debt", ["total debt", "总债务"]),
    ("Long Term Debt", "balance", "Long Term Debt", ["long-term debt", "ltd"]),
    ("Current Debt", "balance", "Current Debt", ["current debt", "short-term debt", "std"]),
    ("Stockholders Equity", "balance", "Stockholders Equity", ["stockholders' equity", "shareholders' equity", "book value", "equity", "股东权益"]),
    ("Working Capital", "balance", "Working Capital", ["working capital", "nwc", "net working capital", "营运资本"]),
    ("Inventory", "balance", "Inventory", ["inventories", "inventory", "stock on hand", "存货"]),
    ("Receivables", "balance", "Receivables", ["accounts receivable", "trade receivables", "receivables", "ar", "应收账款"]),
    ("Accounts Payable", "balance", "Accounts Payable", ["accounts payable", "trade payables", "payables", "ap"]),
    ("Goodwill", "balance", "Goodwill", ["goodwill"]),
    ("Net PPE", "balance", "Property, Plant & Equipment (Net)", ["property, plant and equipment", "property plant equipment", "ppe", "pp&e", "fixed assets"]),
    ("Retained Earnings", "balance", "Retained Earnings", ["retained earnings"]),
    ("Tangible Book Value", "balance", "Tangible Book Value", ["tangible book value", "tbv"]),
    ("Treasury Stock", "balance", "Treasury Stock", ["treasury stock", "treasury shares"]),
    ("marketCap", "info", "Market Cap", ["market capitalization", "market capitalisation", "market cap", "mcap", "市值"]),
    ("forwardPE", "info", "P/E (Forward)", ["forward p/e ratio", "forward p/e", "fwd p/e"]),
    ("trailingPE", "info", "P/E (Trailing)", ["trailing p/e ratio", "trailing p/e", "ttm p/e", "p/e ratio", "p/e", "p e ratio", "市盈率"]),
    ("trailingEps", "info", "EPS (TTM)", ["trailing eps", "ttm eps"]),
    ("forwardEps", "info", "EPS (Forward)", ["forward eps", "fwd eps"]),
    ("sharesOutstanding", "info", "Shares Outstanding", ["shares outstanding", "share count", "outstanding shares", "流通股"]),
    ("dividendYield", "info", "Dividend Yield", ["dividend yield"]),
    ("fiftyTwoWeekHigh", "info", "52-Week High", ["52-week high", "fifty two week high"]),
    ("fiftyTwoWeekLow", "info", "52-Week Low", ["52-week low", "fifty two week low"]),
]


def spellings(name: str) -> list[str]:
    """A name as it is, with blanks for hyphens, without its slash, and without apostrophes and commas."""
    return list(dict.fromkeys([name, name.replace("-", " "), name.replace("p/e", "pe"), name.replace("'", "").replace(",", "")]))


def vocabulary() -> list[tuple[str, str, str, str, int]]:
    """(alias, metric, statement, label, place) of every spelling; the place orders equally long ones."""
    rows = [(s, field, statement, label) for field, statement, label, names in METRICS for n in names for s in spellings(n)]
    return [(*r, i) for i, r in enumerate(rows)]
