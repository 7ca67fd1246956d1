"""Word lists, thresholds and lookup tables that results depend on."""

from decimal import Decimal

# Month -> seasonal index (fixed values)
SEASONAL_INDEX = {1: 0.75, 2: 0.78, 3: 0.85, 4: 0.90, 5: 0.92, 6: 0.88,
                  7: 0.87, 8: 0.91, 9: 0.95, 10: 1.00, 11: 1.25, 12: 1.30}

# Product category -> cost share of price (fixed values)
COST_RATIO = {"Electronics": Decimal("0.65"), "Fashion": Decimal("0.45"),
              "Books": Decimal("0.35"), "Sports": Decimal("0.50"),
              "Beauty": Decimal("0.40"), "Home & Kitchen": Decimal("0.55")}

# Customer segment by number of orders, highest bound first (fixed values)
SEGMENT_STEPS = [(15, "VIP"), (8, "Loyal"), (3, "Regular")]

# Risk level by probability, highest bound first (fixed values)
RISK_STEPS = [(0.7, "high"), (0.4, "medium")]

# Identifier words at the edge of a column name (fixed values)
ID_WORDS = ["id", "code", "no", "num", "number", "key", "ref"]
ID_WORDS_WIDE = ["id", "code", "index", "num", "no", "number", "key", "ref"]
# Words whose columns keep their letter case (fixed values)
CASE_WORDS = ["id", "hash", "code", "token", "url", "key", "ref",
              "uuid", "guid", "sku", "barcode", "serial"]

# Money words, matched anywhere in a column name (fixed values)
MONEY_WORDS = [
    "price", "revenue", "balance", "cost", "amount", "salary", "wage", "pay", "benefit",
    "fee", "payment", "income", "profit", "total", "gross", "net", "earnings", "spend",
    "sales", "invoice", "rate", "charge", "value", "discount", "tax", "taxes", "penalty",
    "fine", "installment", "emi", "budget", "commission", "expense", "expenses", "capital",
    "loan", "debt", "bonus", "incentive", "deposit", "downpayment", "allowance", "fare",
    "funding",
    "السعر", "المبلغ", "الراتب", "الإجمالي", "خصم", "ضريبة", "ضرائب", "غرامة", "غرامات",
    "قسط", "أقساط", "ميزانية", "موازنة", "عمولة", "مصاريف", "نفقات", "مكافأة", "حافز",
    "عربون", "مقدم", "إيداع", "قرض", "ديون", "رسوم", "تكلفة", "إيرادات", "مبيعات",
    "ارباح", "ربح", "رصيد",
]
# Columns that cannot be negative (fixed values)
NON_NEGATIVE_WORDS = ["quantity", "qty", "count", "units", "volume", "stock",
                      "age", "weight", "height", "الكمية"]
# Money columns whose negative sign confirms a return (fixed values)
RETURN_MONEY_WORDS = ["revenue", "total", "amount", "sales", "income", "profit", "payment",
                      "price", "cost", "charge", "invoice", "earnings"]
# Status words that confirm a return (fixed values)
RETURN_WORDS = ["return", "returned", "refund", "refunded", "cancel", "cancelled", "canceled",
                "void", "voided", "reversal", "reversed", "credit", "chargeback",
                "مرتجع", "استرداد", "إلغاء", "مردود"]

# Placeholder texts read as missing (fixed values)
PLACEHOLDERS = ["??", "?", "n/a", "na", "null", "none", "nan", "missing", "unknown", "-", "--",
                "n.a", "nd", "invalid", "error", "not available", "not applicable",
                "undefined", "tbd",
                "لا يوجد", "غير معروف", "فارغ", "مفقود", "خطأ", "غير صالح"]
DATE_PLACEHOLDERS = ["not_a_date", "n/a", "na", "null", "none", "nan", "missing", "unknown",
                     "invalid", "error", "-", "--", "n.a", "nd",
                     "لا يوجد", "غير معروف", "فارغ", "مفقود", "خطأ", "غير صالح"]
TRUE_WORDS = ["true", "yes", "1", "صح", "نعم"]
FALSE_WORDS = ["false", "no", "0", "غلط", "لا"]
NUMBER_WORDS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
                "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
                "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14",
                "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18",
                "nineteen": "19", "twenty": "20", "thirty": "30", "forty": "40",
                "fifty": "50", "hundred": "100"}

# Words in the names of start, end and birth dates, and of primary dates (fixed values)
START_WORDS = ["start", "begin", "from", "open", "issue", "prd_start"]
END_WORDS = ["end", "close", "to", "expire", "finish", "prd_end"]
BIRTH_WORDS = ["birth", "bdate", "dob", "born"]
PRIMARY_DATE_WORDS = ["order", "purchase", "created", "timestamp", "placed",
                      "start", "open", "issued", "booked", "registered"]
# Words for the choice of a grouping column (fixed values)
ENTITY_WORDS = ["customer", "client", "user", "member", "account", "buyer", "seller", "vendor",
                "supplier", "employee", "driver", "agent", "person", "contact"]
GROUP_WORDS_HIGH = ["customer", "client", "product", "category", "segment", "region", "city",
                    "brand", "type", "group", "class", "division", "department", "team",
                    "partner", "vendor", "supplier", "market", "channel", "zone", "area",
                    "عميل", "منتج", "فئة", "قسم", "منطقة", "فرع", "ماركة"]
GROUP_WORDS_LOW = ["status", "state", "flag", "method", "mode", "phase", "stage", "level",
                   "priority", "rating", "grade", "rank", "step",
                   "حالة", "مرحلة", "طريقة", "تقييم"]
SALES_WORDS = ["sales", "sale", "revenue", "مبيعات"]
QUANTITY_WORDS = ["quantity", "qty", "units", "الكمية"]

# Canonical category values: (name words, {written form: canonical}) (fixed values)
CATEGORY_DOMAINS = {
    "gender": (["gen", "gender", "sex"], {
        "m": "male", "male": "male", "man": "male", "boy": "male", "mr": "male", "mr.": "male",
        "f": "female", "female": "female", "woman": "female", "girl": "female",
        "ms": "female", "ms.": "female", "mrs": "female", "mrs.": "female",
        "nb": "non-binary", "non-binary": "non-binary", "nonbinary": "non-binary",
        "non binary": "non-binary", "other": "other", "unknown": "other"}),
    "marital": (["marital", "marital_status", "civil", "relationship"], {
        "s": "single", "single": "single", "unmarried": "single",
        "m": "married", "married": "married", "wed": "married",
        "d": "divorced", "divorced": "divorced",
        "w": "widowed", "widowed": "widowed", "widow": "widowed", "widower": "widowed",
        "sep": "separated", "separated": "separated"}),
    "country": (["country", "nation", "nationality", "country_name", "ctry"], {
        "usa": "1", "us": "1", "u.s.a": "1", "u.s.": "1", "united states": "1",
        "united states of america": "1", "america": "1",
        "uk": "3", "u.k.": "3", "united kingdom": "3", "great britain": "3",
        "britain": "3", "england": "3",
        "uae": "4", "u.a.e": "4", "united arab emirates": "4",
        "eg": "5", "egy": "5", "egypt": "5", "مصر": "5",
        "ksa": "6", "sa": "6", "saudi": "6", "saudi arabia": "6",
        "المملكة العربية السعودية": "6",
        "de": "2", "deu": "2", "germany": "2", "deutschland": "2",
        "fr": "7", "fra": "7", "france": "7",
        "cn": "8", "chn": "8", "china": "8", "prc": "8",
        "in": "9", "ind": "9", "india": "9"}),
}

# Model inputs (fixed values)
MODEL_FEATURES = {
    "revenue": ["quantity_sold", "price", "discount_percent", "seasonal_index",
                "gross_margin_pct", "month", "quarter"],
    "churn": ["customer_tenure_days", "total_orders", "total_spent", "avg_order_value",
              "avg_days_between_orders", "return_rate", "total_items", "avg_rating_given",
              "unique_categories", "spend_per_day", "predicted_clv"],
    "growth": ["monthly_revenue", "lag_1_rev", "lag_2_rev", "mom_growth", "yoy_growth"],
}
# Other names a model input goes by, best first (fixed values)
FEATURE_SYNONYMS = {
    "quantity_sold": ["qty", "quantity", "units", "units_sold", "count", "volume", "items_sold"],
    "price": ["unit_price", "price_each", "order_amount", "amount", "sale_price", "item_price",
              "cost"],
    "discount_percent": ["discount", "discount_pct", "disc", "promotion_percent", "disc_percent"],
    "seasonal_index": ["season_idx", "seasonality", "season"],
    "gross_margin_pct": ["margin", "margin_percent", "gross_margin", "profit_margin"],
    "month": ["month_num", "order_month"],
    "quarter": ["qtr", "fiscal_quarter"],
    "customer_tenure_days": ["tenure", "days_as_customer", "account_age_days", "customer_age"],
    "total_orders": ["order_count", "num_orders", "orders", "total_purchases"],
    "total_spent": ["lifetime_value", "total_revenue", "total_sales", "revenue", "amount_spent"],
    "avg_order_value": ["aov", "average_order", "avg_basket"],
    "avg_days_between_orders": ["order_frequency_days", "days_between", "purchase_frequency"],
    "return_rate": ["returns_rate", "return_pct", "returns_percent"],
    "total_items": ["items_purchased", "total_units", "sku_count"],
    "avg_rating_given": ["rating", "avg_rating", "mean_rating", "review_score"],
    "unique_categories": ["category_count", "num_categories", "categories"],
    "spend_per_day": ["daily_spend", "avg_daily_spend"],
    "predicted_clv": ["clv", "lifetime_value", "customer_value"],
    "monthly_revenue": ["revenue", "sales", "monthly_sales", "total_revenue"],
    "lag_1_rev": ["prev_month_revenue", "last_month_revenue"],
    "lag_2_rev": ["revenue_2_months_ago"],
    "mom_growth": ["month_over_month", "mom", "monthly_growth"],
    "yoy_growth": ["year_over_year", "yoy", "annual_growth"],
}
DATE_HINTS = ["date", "order_date", "purchase_date", "created_at", "timestamp",
              "transaction_date", "invoice_date", "month_label"]
# Roles of an order table, best name first (fixed values)
ROLE_SYNONYMS = {
    "customer_id": ["customer_id", "customerid", "cust_id", "user_id", "subscriber_id",
                    "client_id", "account_id"],
    "date": ["order_date", "date", "purchase_date", "created_at", "timestamp",
             "transaction_date", "invoice_date", "signup_date"],
    "amount": FEATURE_SYNONYMS["price"] + FEATURE_SYNONYMS["total_spent"]
    + ["order_amount", "revenue", "sales", "total"],
    "quantity": FEATURE_SYNONYMS["quantity_sold"],
    "category": ["category", "product_category", "dept", "department"],
    "is_returned": ["is_returned", "returned", "return_flag", "is_return"],
    "rating": FEATURE_SYNONYMS["avg_rating_given"],
    "item_count": FEATURE_SYNONYMS["total_items"],
}
# Dashboard columns, best name first (fixed values)
DASHBOARD_CANDIDATES = {
    "revenue": ["orderamount", "order_amount", "ordertotal", "order_total", "totalprice",
                "total_price", "revenue", "amount", "totalamount", "total_amount", "subtotal",
                "grandtotal", "grand_total", "sales", "salesamount", "sales_amount",
                "netrevenue", "net_revenue"],
    "customer": ["customerid", "customer_id", "custid", "cust_id", "userid", "user_id",
                 "buyerid", "buyer_id", "clientid", "client_id", "customer", "user", "buyer"],
    "order": ["orderid", "order_id", "transactionid", "transaction_id", "invoiceid",
              "invoice_id", "ordernumber", "order_number", "orderno", "order_no"],
    "date": ["orderdate", "order_date", "transactiondate", "transaction_date", "purchasedate",
             "purchase_date", "date", "createdat", "created_at", "timestamp", "datetime",
             "ordertime", "order_time"],
    "category": ["category", "productcategory", "product_category", "categoryname",
                 "category_name", "department", "section", "type", "producttype",
                 "product_type"],
}
# Defaults of model inputs; month and quarter come from an explicit date (fixed values)
FEATURE_DEFAULTS = {"quantity_sold": 1.0, "price": 0.0, "discount_percent": 0.0,
                    "seasonal_index": 1.0, "gross_margin_pct": 0.3,
                    "customer_tenure_days": 180.0, "return_rate": 0.05,
                    "avg_rating_given": 4.0}

# Topic labels by words in the column names (fixed values)
TOPIC_WORDS = {
    "customer churn and retention risk": ["churn", "retention", "cancel", "attrition"],
    "revenue forecasting and sales projections": ["revenue", "forecast", "projection", "sales"],
    "growth metrics and subscription KPIs": ["growth", "mrr", "arr", "subscription"],
    "order transactions and ecommerce activity": ["order", "purchase", "transaction", "cart"],
    "customer demographics and profiles": ["age", "gender", "country", "segment", "customer"],
    "product catalogue and pricing": ["product", "sku", "price", "category"],
    "payment and billing": ["payment", "invoice", "billing", "method"],
}
# Region words -> currency of a table, first hit wins (fixed values)
TABLE_REGIONS = [
    ("EGP", ["egypt", "cairo", "alexandria", "giza", "hurghada"]),
    ("AED", ["uae", "dubai", "abu dhabi", "sharjah"]),
    ("SAR", ["saudi", "riyadh", "jeddah", "dammam"]),
    ("KWD", ["kuwait"]),
    ("USD", ["usa", "united states"]),
    ("GBP", ["uk", "united kingdom", "london"]),
]
# Region words -> currency of a text, first hit wins (fixed values)
TEXT_REGIONS = [
    ("EGP", ["egypt", "cairo", "alexandria", "giza", "hurghada"]),
    ("AED", ["uae", "dubai", "abu dhabi", "sharjah"]),
    ("SAR", ["saudi", "riyadh", "jeddah", "dammam"]),
    ("KWD", ["kuwait"]),
    ("QAR", ["qatar", "doha"]),
    ("BHD", ["bahrain"]),
    ("OMR", ["oman", "muscat"]),
    ("USD", ["usa", "united states", "new york", "los angeles"]),
    ("GBP", ["uk", "united kingdom", "london"]),
    ("EUR", ["euro", "germany", "france", "spain", "italy"]),
]
CURRENCY_CODES = ["egp", "usd", "eur", "gbp", "sar", "aed", "kwd", "qar",
                  "bhd", "omr", "jod", "lbp", "mad", "tnd", "dzd"]
NAME_ACRONYMS = ["EGP", "USD", "ID", "SKU", "SLA", "QTY", "VAT"]

# Question intents, first hit wins (fixed values)
INTENT_WORDS = {
    "churn": ["churn", "retention", "attrition", "cancel", "leave", "churn rate", "churn risk"],
    "revenue_forecast": ["revenue forecast", "forecasted revenue", "predict revenue",
                         "revenue prediction", "sales forecast", "next month revenue",
                         "next period revenue", "12 month revenue", "12 period revenue"],
    "growth": ["growth forecast", "growth projection", "growth rate", "growth prediction",
               "next year growth", "monthly growth", "revenue next year", "next 12 months"],
    "model_accuracy": ["how accurate", "model performance", "mape", "r2", "r-squared",
                       "how reliable", "how good is the model", "roc-auc", "f1 score",
                       "precision", "recall"],
    "top_features": ["top feature", "most important feature", "what drives", "main driver",
                     "key predictor", "feature importance", "what influences",
                     "most predictive"],
}
# Small-talk patterns (fixed values)
CASUAL_PATTERNS = [
    r"^\s*(hi|hello|hey|yo|sup|howdy|hola|salam|salaam)\b",
    r"^\s*good\s*(morning|afternoon|evening|night)",
    r"\bhow\s+are\s+you\b",
    r"\bhow's?\s+it\s+going\b",
    r"\bwhat'?s?\s+up\b",
    r"^\s*thanks?\b",
    r"^\s*thank\s+you\b",
    r"^\s*(ok|okay|cool|nice|great|awesome|got\s+it)\s*$",
    r"^\s*who\s+are\s+you\b",
    r"^\s*what\s+can\s+you\s+do\b",
    r"^\s*help\s*$",
]
# Openings and markers of visible self-talk (fixed values)
LEAK_OPENINGS = ["we need to", "we must", "we should", "we have", "let me", "let's",
                 "i need to", "i should", "i'll", "first, ", "first i", "okay,", "okay ",
                 "sentence 1:", "sentence 1 ", "step 1:", "thinking:", "thought:",
                 "reasoning:", "the user wants", "the user is asking", "the task",
                 "to begin", "to start, "]
LEAK_MARKERS = ["we need to ", "we must ", "let's ", "let me ", "sentence 1:", "step 1:",
                "okay so ", "actually "]
# Evidence tags and hedging phrases (fixed values)
EVIDENCE_TAGS = ["observed", "derived", "inferred", "assumption"]
HEDGES = [" likely ", " inferred ", " implied ", " suggests ", " may be ", " might be ",
          " probably ", " possibly ", " appears to ", " seems to ", " is presumed ",
          " could be ", " would be ", " might ", " may "]
STRONG_HEDGES = [" is likely ", " are likely ", " was likely ", " were likely ",
                 " is inferred ", " are inferred ", " is presumed ", " are presumed ",
                 " is implied ", " are implied ", " probably is ", " probably are ",
                 " appears to be ", " appears to ", " seems to be ", " seems to ",
                 "likely indicates", "likely reflects", "is presumably"]
# Canvas blocks that order data alone cannot support (fixed values)
HARD_BLOCKS = ["key_partners", "key_activities", "cost_structure", "key_resources"]

# Inputs computed from revenue itself (fixed values)
REVENUE_LEAKS = ["refund_amount", "is_returned", "return_reason", "cost_of_goods",
                 "gross_margin_pct", "net_revenue", "discount_amount"]
DECISION_IMPACT = {"revenue": "medium", "churn": "high", "growth": "medium"}
DECISION_LABEL = {"revenue": "Pricing & revenue optimisation",
                  "churn": "Customer retention campaigns",
                  "growth": "Growth & capacity planning"}
# (confidence, impact) -> (gate, rationale) (fixed values)
GATES = {
    ("high", "high"): ("✅ Proceed", "High confidence, well-validated."),
    ("high", "medium"): ("✅ Proceed", "High confidence, well-validated."),
    ("high", "low"): ("✅ Proceed", "High confidence, well-validated."),
    ("medium", "high"): ("⚠️ Pilot only", "Medium confidence, high impact -- validate at small "
                         "scale before full rollout."),
    ("medium", "medium"): ("⚠️ Pilot only", "Validate at small scale before full rollout."),
    ("medium", "low"): ("⚠️ Pilot only", "Acceptable for a pilot."),
    ("low", "high"): ("🚨 Escalate", "Low confidence on a HIGH-impact decision -- requires human "
                      "review before any commitment."),
    ("low", "medium"): ("❌ Block", "Address the underlying limitation before acting."),
    ("low", "low"): ("❌ Block", "Address the underlying limitation before acting."),
}

# Inputs of the three trained models (fixed values)
REVENUE_MODEL_INPUTS = ["year", "month", "quarter", "week_of_year", "day_of_week", "is_weekend",
                        "seasonal_index", "product_category", "customer_region",
                        "payment_method", "price", "discount_percent", "quantity_sold",
                        "discounted_price", "rating", "review_count", "revenue_lag_7d",
                        "revenue_lag_30d", "revenue_roll_7d", "revenue_roll_30d",
                        "revenue_roll_90d", "orders_roll_7d"]
CHURN_MODEL_INPUTS = ["customer_tenure_days", "total_orders", "total_spent", "avg_order_value",
                      "avg_days_between_orders", "return_rate", "total_items",
                      "avg_rating_given", "unique_categories", "spend_per_day",
                      "predicted_clv", "customer_segment", "preferred_region"]
GROWTH_MODEL_INPUTS = ["lag_1_rev", "lag_2_rev", "lag_3_rev", "lag_12_rev", "monthly_orders",
                       "new_customers", "avg_order_value", "yoy_growth", "month_num",
                       "sin_m", "cos_m"]
