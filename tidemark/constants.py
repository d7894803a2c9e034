"""Names, limits, thresholds and message texts of the results."""

# State names and postal codes of the map lookup.
STATE_CODES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA",
    "Colorado": "CO", "Connecticut": "CT", "Delaware": "DE", "District of Columbia": "DC",
    "Florida": "FL", "Georgia": "GA", "Hawaii": "HI", "Idaho": "ID", "Illinois": "IL",
    "Indiana": "IN", "Iowa": "IA", "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA",
    "Maine": "ME", "Maryland": "MD", "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN",
    "Mississippi": "MS", "Missouri": "MO", "Montana": "MT", "Nebraska": "NE", "Nevada": "NV",
    "New Hampshire": "NH", "New Jersey": "NJ", "New Mexico": "NM", "New York": "NY",
    "North Carolina": "NC", "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK", "Oregon": "OR",
    "Pennsylvania": "PA", "Rhode Island": "RI", "South Carolina": "SC", "South Dakota": "SD",
    "Tennessee": "TN", "Texas": "TX", "Utah": "UT", "Vermont": "VT", "Virginia": "VA",
    "Washington": "WA", "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY",
}

# Bar sizes and how many of the latest bars are kept per size.
BAR_SECONDS = {"1h": 3600, "4h": 14400, "1d": 86400, "1w": 604800}
BAR_LIMITS = {"1h": 500, "4h": 500, "1d": 365, "1w": 104}

# Positional fields of a kline record, and those that are parsed as numbers.
KLINE_FIELDS = [
    "open_time", "open", "high", "low", "close", "volume",
    "close_time", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote", "ignore",
]
KLINE_NUMBERS = ["open", "high", "low", "close", "volume", "quote_volume"]

# Risk bands, tenure bands and charge bands.
RISK_LEVELS = ["Low Risk", "Medium Risk", "High Risk"]
RISK_EDGES = [-0.001, 0.34, 0.67, 1.001]
TENURE_LABELS = ["0-12", "13-36", "37-72", "73+"]
TENURE_EDGES = [12, 36, 72]
CHARGE_LABELS = ["Budget", "Core", "Premium", "Enterprise"]
OVERAGE_LABELS = ["Low overage", "Moderate overage", "High overage"]

# Column names that are looked for in customer tables.
TARGET_NAMES = ["Churn", "churn", "Exited", "Attrition", "is_churn", "Customer_Status", "target", "label"]
ID_LIKE_NAMES = ["customerid", "customer_id", "id", "name", "email", "phone"]
ID_COLUMNS = ["customerID", "CustomerID", "customer_id"]
POSITIVE_WORDS = ["yes", "true", "1", "churn", "churned", "left", "exited", "lost", "cancelled"]
TENURE_KEYWORDS = ["tenure", "accountweeks", "account_week"]
CHARGE_KEYWORDS = ["monthlycharge", "monthly_charge", "monthlycharges", "charge"]
CONTRACT_KEYWORDS = ["contract"]
PAYMENT_KEYWORDS = ["payment"]

# Coefficients of the transparent churn score.
SCORE_INTERCEPT = -2.1
SCORE_MONTH_TO_MONTH = 1.35
SCORE_ELECTRONIC_CHECK = 0.55
SCORE_HIGH_CHARGE = 0.55
SCORE_MANY_TICKETS = 0.9
SCORE_PER_TENURE_MONTH = -0.025
HIGH_CHARGE = 88
MANY_TICKETS = 4

# Messages of the dataset check.
CHECK_TARGET_MISSING = "The selected target column is missing from the dataset."
CHECK_TWO_CLASSES = "The target column must contain exactly two classes for churn classification."
CHECK_ROWS = "At least 50 rows are recommended for stable model training."
CHECK_FEATURES = "The dataset needs at least two usable feature columns."

# Market rule texts; {name} marks a number put in by the rule.
MARKET_TEXTS = {
    "overbought": ("badge-bearish", "Overbought Signal",
                   "{symbol} RSI at {rsi} — market is overbought. Watch for a potential pullback or consolidation phase."),
    "oversold": ("badge-bullish", "Oversold Signal",
                 "{symbol} RSI at {rsi} — deeply oversold territory. Potential mean reversion or bounce opportunity."),
    "rsi_neutral": ("badge-neutral", "RSI Neutral",
                    "{symbol} RSI at {rsi} — neither overbought nor oversold. Momentum is balanced."),
    "cross_up": ("badge-bullish", "MACD Crossover",
                 "Bullish MACD crossover detected — momentum turning positive. Historically a buy signal in trending markets."),
    "cross_down": ("badge-bearish", "MACD Crossover",
                   "Bearish MACD crossover detected — downward momentum building. Consider tightening stops or reducing exposure."),
    "trend_up": ("badge-bullish", "MACD Trend",
                 "MACD is bullish at {macd}. No fresh crossover — current trend is in continuation mode."),
    "trend_down": ("badge-bearish", "MACD Trend",
                   "MACD is bearish at {macd}. No fresh crossover — current trend is in continuation mode."),
    "golden": ("badge-bullish", "Golden Cross Zone",
               "MA20 ({ma20}) is above MA50 ({ma50}) — price structure remains bullish on this timeframe."),
    "death": ("badge-bearish", "Death Cross Zone",
              "MA20 ({ma20}) is below MA50 ({ma50}) — bearish structure. Rallies may face resistance at moving averages."),
    "above_band": ("badge-bearish", "Bollinger Band Breakout",
                   "Price has broken above the upper Bollinger Band — extended move. Expect volatility or mean reversion soon."),
    "below_band": ("badge-bullish", "Bollinger Band Squeeze",
                   "Price is below the lower Bollinger Band — potential oversold extreme. High-risk contrarian entry zone."),
    "narrow_band": ("badge-neutral", "Volatility Squeeze",
                    "Bollinger Band width at {width}% — historically low volatility. A significant directional move may be imminent."),
    "high_vol": ("badge-bearish", "High Volatility Regime",
                 "Annualized volatility at {vol}% — elevated risk environment. Position sizing should reflect heightened uncertainty."),
    "low_vol": ("badge-neutral", "Low Volatility",
                "Annualized volatility at {vol}% — unusually calm. Low-volatility periods often precede sharp moves."),
}

# Correlation classes, texts and badges.
CORRELATION_TEXTS = {
    "high": ("badge-neutral",
             "{a} and {b} are highly correlated — they tend to move together, limiting diversification benefit during this period."),
    "moderate": ("badge-neutral",
                 "Moderate correlation between {a} and {b}. Some diversification benefit exists, though assets share directional bias."),
    "low": ("badge-bullish",
            "Low correlation detected — {a} and {b} are diverging. This presents a potential diversification opportunity."),
}

# Volatility outlook texts.
VOL_ELEVATED = "elevated risk environment requiring careful position sizing."
VOL_MODERATE = "moderate volatility environment suitable for systematic strategies."

# Retention insight titles and texts.
RETENTION_TEXTS = {
    "queue": ("Retention Queue",
              "{rate} of customers are high risk. Prioritize this segment for proactive save offers and customer success outreach."),
    "tenure": ("Tenure Signal",
               "Customers in the {segment} tenure band show the highest predicted churn probability at {rate}."),
    "contract": ("Contract Exposure",
                 "{segment} customers carry the highest churn exposure. Renewal campaigns should focus there first."),
    "payment": ("Payment Pattern",
                "The {segment} payment segment has elevated risk. Review billing friction, failed payments, and plan-fit messaging."),
}

# Executive summary titles and texts.
SUMMARY_TEXTS = {
    "trend": ("Churn Trend",
              "The current model estimates a {rate} churn rate with an average customer churn probability of {mean}."),
    "risk": ("Risk Observation",
             "{high} customers are classified as high risk and should be routed into retention workflows within the next campaign cycle."),
    "advice": ("Retention Recommendation",
               "Launch tiered interventions: fast-response outreach for high-risk accounts, education journeys for medium-risk users, and loyalty reinforcement for low-risk customers."),
    "impact": ("Business Impact", "Estimated monthly revenue at risk is {revenue}."),
    "no_impact": ("Business Impact",
                  "Revenue-at-risk estimation will activate when a monthly charge column is present."),
}

# Sentences about the strongest model drivers.
DRIVERS_NONE = "The model did not expose ranked drivers, but the churn scores remain available for operational prioritization."
DRIVERS_TEXT = (
    "The strongest churn signals in this portfolio are {features}. "
    "Retention teams should use these drivers to shape targeted outreach, pricing interventions, "
    "onboarding support, and contract renewal campaigns."
)
