"""The metrics of the catalogue, one record each, as they are handed out."""

# Fixed values.
METRICS = [
    {
        "kpi_key": "revenue",
        "name": "Revenue",
        "definition": "Consolidated operating revenue or net sales.",
        "accepted_labels": ["Revenue", "Revenues", "Net sales"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value", "interest income alone"],
        "preferred_statements": ["Consolidated Statements of Operations", "Consolidated Income Statement"],
        "retrieval_hints": [
            "Search Consolidated Statements of Operations, Consolidated Income Statement first.",
            "Try the exact labels: Revenue, Revenues, Net sales.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Apply only the monetary scale governing the selected row; preserve the reported sign.",
        "cautions": [
            "Use the consolidated target-year value.",
            "Reject prior-year, quarterly, segment, and non-GAAP values.",
            "Do not substitute a component or segment total for the consolidated top line.",
        ],
    },
    {
        "kpi_key": "cost_of_revenue",
        "name": "Cost of revenue",
        "definition": "Cost of goods and services sold.",
        "accepted_labels": ["Cost of revenue", "Cost of sales", "Cost of goods sold"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value"],
        "preferred_statements": ["Consolidated Statements of Operations", "Consolidated Income Statement"],
        "retrieval_hints": [
            "Search Consolidated Statements of Operations, Consolidated Income Statement first.",
            "Try the exact labels: Cost of revenue, Cost of sales, Cost of goods sold.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Apply the governing monetary scale and return the expense magnitude as positive.",
        "cautions": ["Use the consolidated target-year value.", "Reject prior-year, quarterly, segment, and non-GAAP values."],
    },
    {
        "kpi_key": "gross_profit",
        "name": "Gross profit",
        "definition": "Revenue less cost of revenue as printed by the company.",
        "accepted_labels": ["Gross profit", "Gross margin"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value"],
        "preferred_statements": ["Consolidated Statements of Operations", "Consolidated Income Statement"],
        "retrieval_hints": [
            "Search Consolidated Statements of Operations, Consolidated Income Statement first.",
            "Try the exact labels: Gross profit, Gross margin.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Apply only the monetary scale governing the selected row; preserve the reported sign.",
        "cautions": [
            "Use the consolidated target-year value.",
            "Reject prior-year, quarterly, segment, and non-GAAP values.",
            "Do not calculate gross profit when no printed total is available.",
        ],
    },
    {
        "kpi_key": "rd_expense",
        "name": "Research and development expense",
        "definition": "Research and development expense only.",
        "accepted_labels": ["Research and development", "R&D expense"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value", "research and development plus SG&A"],
        "preferred_statements": ["Consolidated Statements of Operations", "Consolidated Income Statement"],
        "retrieval_hints": [
            "Search Consolidated Statements of Operations, Consolidated Income Statement first.",
            "Try the exact labels: Research and development, R&D expense.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Apply the governing monetary scale and return the expense magnitude as positive.",
        "cautions": ["Use the consolidated target-year value.", "Reject prior-year, quarterly, segment, and non-GAAP values."],
    },
    {
        "kpi_key": "sga_expense",
        "name": "Selling, general and administrative expense",
        "definition": "Combined selling, general and administrative expense.",
        "accepted_labels": ["Selling, general and administrative", "SG&A", "General and administrative"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value"],
        "preferred_statements": ["Consolidated Statements of Operations", "Consolidated Income Statement"],
        "retrieval_hints": [
            "Search Consolidated Statements of Operations, Consolidated Income Statement first.",
            "Try the exact labels: Selling, general and administrative, SG&A, General and administrative.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Apply the governing monetary scale and return the expense magnitude as positive.",
        "cautions": ["Use the consolidated target-year value.", "Reject prior-year, quarterly, segment, and non-GAAP values."],
    },
    {
        "kpi_key": "operating_income",
        "name": "Operating income",
        "definition": "Operating income or operating profit.",
        "accepted_labels": ["Operating income", "Income from operations", "Operating profit"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value"],
        "preferred_statements": ["Consolidated Statements of Operations", "Consolidated Income Statement"],
        "retrieval_hints": [
            "Search Consolidated Statements of Operations, Consolidated Income Statement first.",
            "Try the exact labels: Operating income, Income from operations, Operating profit.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Apply only the monetary scale governing the selected row; preserve the reported sign.",
        "cautions": ["Use the consolidated target-year value.", "Reject prior-year, quarterly, segment, and non-GAAP values."],
    },
    {
        "kpi_key": "interest_expense",
        "name": "Interest expense",
        "definition": "Interest expense on debt.",
        "accepted_labels": ["Interest expense", "Finance costs", "Finance expense"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value", "interest income", "net interest income"],
        "preferred_statements": ["Consolidated Statements of Operations", "Consolidated Income Statement"],
        "retrieval_hints": [
            "Search Consolidated Statements of Operations, Consolidated Income Statement first.",
            "Try the exact labels: Interest expense, Finance costs, Finance expense.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Apply the governing monetary scale and return the expense magnitude as positive.",
        "cautions": ["Use the consolidated target-year value.", "Reject prior-year, quarterly, segment, and non-GAAP values."],
    },
    {
        "kpi_key": "income_tax_expense",
        "name": "Income tax expense",
        "definition": "Income tax expense or benefit.",
        "accepted_labels": ["Income tax expense", "Provision for income taxes", "Income tax benefit"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value"],
        "preferred_statements": ["Consolidated Statements of Operations", "Consolidated Income Statement"],
        "retrieval_hints": [
            "Search Consolidated Statements of Operations, Consolidated Income Statement first.",
            "Try the exact labels: Income tax expense, Provision for income taxes, Income tax benefit.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Apply only the monetary scale governing the selected row; preserve the reported sign.",
        "cautions": ["Use the consolidated target-year value.", "Reject prior-year, quarterly, segment, and non-GAAP values."],
    },
    {
        "kpi_key": "net_income",
        "name": "Net income",
        "definition": "Net income attributable to the parent or common shareholders.",
        "accepted_labels": ["Net income attributable to common shareholders", "Net income attributable to parent", "Net income"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value", "net income including non-controlling interests"],
        "preferred_statements": ["Consolidated Statements of Operations", "Consolidated Income Statement"],
        "retrieval_hints": [
            "Search Consolidated Statements of Operations, Consolidated Income Statement first.",
            "Try the exact labels: Net income attributable to common shareholders, Net income attributable to parent, Net income.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Apply only the monetary scale governing the selected row; preserve the reported sign.",
        "cautions": [
            "Use the consolidated target-year value.",
            "Reject prior-year, quarterly, segment, and non-GAAP values.",
            "Prefer the amount attributable to the parent and exclude NCI.",
        ],
    },
    {
        "kpi_key": "eps_basic",
        "name": "Basic EPS",
        "definition": "Basic earnings per common share.",
        "accepted_labels": ["Basic earnings per share", "Basic EPS"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value", "diluted EPS"],
        "preferred_statements": ["Consolidated Statements of Operations", "Consolidated Income Statement"],
        "retrieval_hints": [
            "Search Consolidated Statements of Operations, Consolidated Income Statement first.",
            "Try the exact labels: Basic earnings per share, Basic EPS.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Return the printed per-share amount without applying monetary statement scaling.",
        "cautions": ["Use the consolidated target-year value.", "Reject prior-year, quarterly, segment, and non-GAAP values."],
    },
    {
        "kpi_key": "eps_diluted",
        "name": "Diluted EPS",
        "definition": "Diluted earnings per common share.",
        "accepted_labels": ["Diluted earnings per share", "Diluted EPS"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value", "basic EPS"],
        "preferred_statements": ["Consolidated Statements of Operations", "Consolidated Income Statement"],
        "retrieval_hints": [
            "Search Consolidated Statements of Operations, Consolidated Income Statement first.",
            "Try the exact labels: Diluted earnings per share, Diluted EPS.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Return the printed per-share amount without applying monetary statement scaling.",
        "cautions": ["Use the consolidated target-year value.", "Reject prior-year, quarterly, segment, and non-GAAP values."],
    },
    {
        "kpi_key": "total_assets",
        "name": "Total assets",
        "definition": "Total assets at fiscal year end.",
        "accepted_labels": ["Total assets"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value"],
        "preferred_statements": ["Consolidated Balance Sheets", "Consolidated Statement of Financial Position"],
        "retrieval_hints": [
            "Search Consolidated Balance Sheets, Consolidated Statement of Financial Position first.",
            "Try the exact labels: Total assets.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Apply only the monetary scale governing the selected row; preserve the reported sign.",
        "cautions": ["Use the consolidated target-year value.", "Reject prior-year, quarterly, segment, and non-GAAP values."],
    },
    {
        "kpi_key": "total_liabilities",
        "name": "Total liabilities",
        "definition": "Total liabilities at fiscal year end.",
        "accepted_labels": ["Total liabilities"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value", "total liabilities and equity"],
        "preferred_statements": ["Consolidated Balance Sheets", "Consolidated Statement of Financial Position"],
        "retrieval_hints": [
            "Search Consolidated Balance Sheets, Consolidated Statement of Financial Position first.",
            "Try the exact labels: Total liabilities.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Apply only the monetary scale governing the selected row; preserve the reported sign.",
        "cautions": ["Use the consolidated target-year value.", "Reject prior-year, quarterly, segment, and non-GAAP values."],
    },
    {
        "kpi_key": "stockholders_equity",
        "name": "Stockholders' equity",
        "definition": "Equity attributable to the parent, excluding NCI.",
        "accepted_labels": ["Total stockholders' equity", "Shareholders' equity attributable to owners"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value", "total equity including NCI"],
        "preferred_statements": ["Consolidated Balance Sheets", "Consolidated Statement of Financial Position"],
        "retrieval_hints": [
            "Search Consolidated Balance Sheets, Consolidated Statement of Financial Position first.",
            "Try the exact labels: Total stockholders' equity, Shareholders' equity attributable to owners.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Apply only the monetary scale governing the selected row; preserve the reported sign.",
        "cautions": [
            "Use the consolidated target-year value.",
            "Reject prior-year, quarterly, segment, and non-GAAP values.",
            "Exclude non-controlling interest.",
        ],
    },
    {
        "kpi_key": "stockholders_equity_incl_nci",
        "name": "Total equity including NCI",
        "definition": "Total equity including non-controlling interests.",
        "accepted_labels": ["Total equity", "Stockholders' equity and non-controlling interests"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value"],
        "preferred_statements": ["Consolidated Balance Sheets", "Consolidated Statement of Financial Position"],
        "retrieval_hints": [
            "Search Consolidated Balance Sheets, Consolidated Statement of Financial Position first.",
            "Try the exact labels: Total equity, Stockholders' equity and non-controlling interests.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Apply only the monetary scale governing the selected row; preserve the reported sign.",
        "cautions": [
            "Use the consolidated target-year value.",
            "Reject prior-year, quarterly, segment, and non-GAAP values.",
            "Require a total that includes NCI.",
        ],
    },
    {
        "kpi_key": "cash_and_equivalents",
        "name": "Cash and cash equivalents",
        "definition": "Unrestricted cash and cash equivalents at period end.",
        "accepted_labels": ["Cash and cash equivalents"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value", "cash including restricted cash"],
        "preferred_statements": ["Consolidated Balance Sheets", "Consolidated Statement of Financial Position"],
        "retrieval_hints": [
            "Search Consolidated Balance Sheets, Consolidated Statement of Financial Position first.",
            "Try the exact labels: Cash and cash equivalents.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Apply only the monetary scale governing the selected row; preserve the reported sign.",
        "cautions": [
            "Use the consolidated target-year value.",
            "Reject prior-year, quarterly, segment, and non-GAAP values.",
            "Exclude restricted cash.",
        ],
    },
    {
        "kpi_key": "cash_incl_restricted",
        "name": "Cash including restricted cash",
        "definition": "Cash, cash equivalents, and restricted cash combined.",
        "accepted_labels": ["Cash, cash equivalents and restricted cash"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value", "cash and cash equivalents alone"],
        "preferred_statements": ["Consolidated Statements of Cash Flows"],
        "retrieval_hints": [
            "Search Consolidated Statements of Cash Flows first.",
            "Try the exact labels: Cash, cash equivalents and restricted cash.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Apply only the monetary scale governing the selected row; preserve the reported sign.",
        "cautions": ["Use the consolidated target-year value.", "Reject prior-year, quarterly, segment, and non-GAAP values."],
    },
    {
        "kpi_key": "long_term_debt_total",
        "name": "Total long-term debt",
        "definition": "Printed total long-term debt excluding a separately reported current portion.",
        "accepted_labels": ["Total long-term debt", "Long-term debt"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value"],
        "preferred_statements": ["Consolidated Balance Sheets", "Consolidated Statement of Financial Position"],
        "retrieval_hints": [
            "Search Consolidated Balance Sheets, Consolidated Statement of Financial Position first.",
            "Try the exact labels: Total long-term debt, Long-term debt.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Apply only the monetary scale governing the selected row; preserve the reported sign.",
        "cautions": [
            "Use the consolidated target-year value.",
            "Reject prior-year, quarterly, segment, and non-GAAP values.",
            "Do not double count a separately printed current portion.",
        ],
    },
    {
        "kpi_key": "long_term_debt_noncurrent",
        "name": "Noncurrent long-term debt",
        "definition": "Long-term debt classified as noncurrent.",
        "accepted_labels": ["Long-term debt, noncurrent", "Long-term debt less current portion"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value", "current portion of long-term debt"],
        "preferred_statements": ["Consolidated Balance Sheets", "Consolidated Statement of Financial Position"],
        "retrieval_hints": [
            "Search Consolidated Balance Sheets, Consolidated Statement of Financial Position first.",
            "Try the exact labels: Long-term debt, noncurrent, Long-term debt less current portion.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Apply only the monetary scale governing the selected row; preserve the reported sign.",
        "cautions": ["Use the consolidated target-year value.", "Reject prior-year, quarterly, segment, and non-GAAP values."],
    },
    {
        "kpi_key": "long_term_debt_current",
        "name": "Current portion of long-term debt",
        "definition": "Current maturities or current portion of long-term debt.",
        "accepted_labels": ["Current portion of long-term debt", "Current maturities of long-term debt"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value", "all short-term borrowings"],
        "preferred_statements": ["Consolidated Balance Sheets", "Consolidated Statement of Financial Position"],
        "retrieval_hints": [
            "Search Consolidated Balance Sheets, Consolidated Statement of Financial Position first.",
            "Try the exact labels: Current portion of long-term debt, Current maturities of long-term debt.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Apply only the monetary scale governing the selected row; preserve the reported sign.",
        "cautions": ["Use the consolidated target-year value.", "Reject prior-year, quarterly, segment, and non-GAAP values."],
    },
    {
        "kpi_key": "short_term_borrowings",
        "name": "Short-term borrowings",
        "definition": "Borrowings with original maturity of one year or less.",
        "accepted_labels": ["Short-term borrowings", "Short-term debt", "Commercial paper"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value", "current portion of long-term debt alone"],
        "preferred_statements": ["Consolidated Balance Sheets", "Consolidated Statement of Financial Position"],
        "retrieval_hints": [
            "Search Consolidated Balance Sheets, Consolidated Statement of Financial Position first.",
            "Try the exact labels: Short-term borrowings, Short-term debt, Commercial paper.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Apply only the monetary scale governing the selected row; preserve the reported sign.",
        "cautions": ["Use the consolidated target-year value.", "Reject prior-year, quarterly, segment, and non-GAAP values."],
    },
    {
        "kpi_key": "inventory",
        "name": "Inventory",
        "definition": "Inventory net of allowances at period end.",
        "accepted_labels": ["Inventories", "Inventory, net"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value"],
        "preferred_statements": ["Consolidated Balance Sheets", "Consolidated Statement of Financial Position"],
        "retrieval_hints": [
            "Search Consolidated Balance Sheets, Consolidated Statement of Financial Position first.",
            "Try the exact labels: Inventories, Inventory, net.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Apply only the monetary scale governing the selected row; preserve the reported sign.",
        "cautions": ["Use the consolidated target-year value.", "Reject prior-year, quarterly, segment, and non-GAAP values."],
    },
    {
        "kpi_key": "accounts_receivable",
        "name": "Accounts receivable",
        "definition": "Current trade accounts receivable net of allowance.",
        "accepted_labels": ["Accounts receivable, net", "Trade receivables"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value", "noncurrent receivables"],
        "preferred_statements": ["Consolidated Balance Sheets", "Consolidated Statement of Financial Position"],
        "retrieval_hints": [
            "Search Consolidated Balance Sheets, Consolidated Statement of Financial Position first.",
            "Try the exact labels: Accounts receivable, net, Trade receivables.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Apply only the monetary scale governing the selected row; preserve the reported sign.",
        "cautions": ["Use the consolidated target-year value.", "Reject prior-year, quarterly, segment, and non-GAAP values."],
    },
    {
        "kpi_key": "accounts_payable",
        "name": "Accounts payable",
        "definition": "Current trade accounts payable.",
        "accepted_labels": ["Accounts payable", "Trade payables"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value", "accounts payable and unrelated accrued liabilities"],
        "preferred_statements": ["Consolidated Balance Sheets", "Consolidated Statement of Financial Position"],
        "retrieval_hints": [
            "Search Consolidated Balance Sheets, Consolidated Statement of Financial Position first.",
            "Try the exact labels: Accounts payable, Trade payables.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Apply only the monetary scale governing the selected row; preserve the reported sign.",
        "cautions": ["Use the consolidated target-year value.", "Reject prior-year, quarterly, segment, and non-GAAP values."],
    },
    {
        "kpi_key": "shares_outstanding",
        "name": "Shares outstanding",
        "definition": "Common shares outstanding at fiscal year end.",
        "accepted_labels": ["Common shares outstanding", "Shares outstanding"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value", "weighted-average shares"],
        "preferred_statements": ["Consolidated Balance Sheets", "Consolidated Statement of Financial Position"],
        "retrieval_hints": [
            "Search Consolidated Balance Sheets, Consolidated Statement of Financial Position first.",
            "Try the exact labels: Common shares outstanding, Shares outstanding.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Apply only a clearly governing share-count scale and return the raw share count.",
        "cautions": ["Use the consolidated target-year value.", "Reject prior-year, quarterly, segment, and non-GAAP values."],
    },
    {
        "kpi_key": "operating_cash_flow",
        "name": "Operating cash flow",
        "definition": "Net cash provided by or used in operating activities.",
        "accepted_labels": ["Net cash provided by operating activities", "Net cash used in operating activities"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value"],
        "preferred_statements": ["Consolidated Statements of Cash Flows"],
        "retrieval_hints": [
            "Search Consolidated Statements of Cash Flows first.",
            "Try the exact labels: Net cash provided by operating activities, Net cash used in operating activities.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Apply only the monetary scale governing the selected row; preserve the reported sign.",
        "cautions": ["Use the consolidated target-year value.", "Reject prior-year, quarterly, segment, and non-GAAP values."],
    },
    {
        "kpi_key": "investing_cash_flow",
        "name": "Investing cash flow",
        "definition": "Net cash provided by or used in investing activities.",
        "accepted_labels": ["Net cash provided by investing activities", "Net cash used in investing activities"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value"],
        "preferred_statements": ["Consolidated Statements of Cash Flows"],
        "retrieval_hints": [
            "Search Consolidated Statements of Cash Flows first.",
            "Try the exact labels: Net cash provided by investing activities, Net cash used in investing activities.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Apply only the monetary scale governing the selected row; preserve the reported sign.",
        "cautions": ["Use the consolidated target-year value.", "Reject prior-year, quarterly, segment, and non-GAAP values."],
    },
    {
        "kpi_key": "financing_cash_flow",
        "name": "Financing cash flow",
        "definition": "Net cash provided by or used in financing activities.",
        "accepted_labels": ["Net cash provided by financing activities", "Net cash used in financing activities"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value"],
        "preferred_statements": ["Consolidated Statements of Cash Flows"],
        "retrieval_hints": [
            "Search Consolidated Statements of Cash Flows first.",
            "Try the exact labels: Net cash provided by financing activities, Net cash used in financing activities.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Apply only the monetary scale governing the selected row; preserve the reported sign.",
        "cautions": ["Use the consolidated target-year value.", "Reject prior-year, quarterly, segment, and non-GAAP values."],
    },
    {
        "kpi_key": "capex",
        "name": "Capital expenditure",
        "definition": "Cash paid to acquire property, plant, and equipment.",
        "accepted_labels": ["Purchases of property, plant and equipment", "Capital expenditures"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value", "total investing cash flow"],
        "preferred_statements": ["Consolidated Statements of Cash Flows"],
        "retrieval_hints": [
            "Search Consolidated Statements of Cash Flows first.",
            "Try the exact labels: Purchases of property, plant and equipment, Capital expenditures.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Apply the governing monetary scale and return the cash outflow as positive.",
        "cautions": ["Use the consolidated target-year value.", "Reject prior-year, quarterly, segment, and non-GAAP values."],
    },
    {
        "kpi_key": "depreciation_amortization",
        "name": "Depreciation and amortization",
        "definition": "Depreciation, depletion, and amortization addback.",
        "accepted_labels": ["Depreciation and amortization", "Depreciation, depletion and amortization", "Depreciation"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value"],
        "preferred_statements": ["Consolidated Statements of Cash Flows"],
        "retrieval_hints": [
            "Search Consolidated Statements of Cash Flows first.",
            "Try the exact labels: Depreciation and amortization, Depreciation, depletion and amortization, Depreciation.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Apply the governing monetary scale and return the expense magnitude as positive.",
        "cautions": ["Use the consolidated target-year value.", "Reject prior-year, quarterly, segment, and non-GAAP values."],
    },
    {
        "kpi_key": "dividends_paid",
        "name": "Dividends paid",
        "definition": "Cash dividends paid to common shareholders.",
        "accepted_labels": ["Dividends paid", "Payments of dividends"],
        "rejected_labels": ["segment value", "quarterly value", "adjusted non-GAAP value", "dividends declared"],
        "preferred_statements": ["Consolidated Statements of Cash Flows"],
        "retrieval_hints": [
            "Search Consolidated Statements of Cash Flows first.",
            "Try the exact labels: Dividends paid, Payments of dividends.",
            "Read the target-year column and the unit governing the selected row.",
        ],
        "normalization_rule": "Apply the governing monetary scale and return the cash outflow as positive.",
        "cautions": ["Use the consolidated target-year value.", "Reject prior-year, quarterly, segment, and non-GAAP values."],
    },
]
