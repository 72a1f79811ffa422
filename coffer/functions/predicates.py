"""Row predicates over transactions (PRD-01..12): words in memo, category and merchant.

Every predicate takes a frame's columns by name (memo, category, merchant_raw,
merchant) and returns a boolean column; nulls count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import contains_any, folded, signals_any

# The word lists that results depend on.
REFUND = ["refund", "reversal"]
PLANNED = ["membership", "monthly", "subscription", "plan", "enrolled", "autopay"]
MOVEMENT = [
    "transfer", "external transfer", "standard transfer", "wire transfer", "bank account", "money out", "auto payment",
    "electronic withdrawal", "credit card payment", "card payment", "automated transaction buy", "securities buy",
    "investment buy", "withdrawal", "deposit", "loan payment", "student loan", "rent", "mortgage", "taxes",
    "financial fee", "wire fee", "atm fee", "parking",
]
BILLS = [
    "tv & internet", "internet", "utilities", "utility", "water", "auto insurance", "insurance", "groceries", "grocery",
    "clothing", "home improvement", "moving", "paying into business", "family wedding tracker", "house supplies",
    "personal care", "supplements",
]
NOISE = [
    "amazon mktpl", "marketplace", "uber trip", "warehouse trip", "costco whse", "home depot", "u haul", "vuori",
    "gourmet", "marketplace order", "online order", "pickup order", "shipment", "delivery",
]
SERVICE_CATEGORIES = [
    "business subscriptions", "ai subscriptions", "subscriptions", "subscription", "software", "ai", "security", "news",
    "audiobooks", "streaming", "home security",
]
SERVICE = [
    "subscription", "subscr", "membership", "renewal", "plan", "premium", "plus", "pro", "workspace", "cloud", "hosting",
    "domain", "license", "streaming", "ai subscription", "home security",
]
STRONG = [
    "subscription", "subscribe", "subscr", "subs", "membership", "member", "renew", "renewal", "plan", "premium",
    "billing", "billed", "rebill", "icloud", "prime", "hosting", "domain", "license", "licence", "seat", "monthly fee",
    "annual fee", "access fee", "streaming", "per month", "per year", "/mo", "/yr",
]
EXPLICIT = [
    "subscription", "subscribe", "subscr", "subs", "membership", "member", "renew", "renewal", "plan", "premium", "plus",
    "monthly", "annual", "yearly", "autopay", "auto-pay", "auto pay", "auto-renew", "auto renew", "recurring", "billing",
    "billed", "rebill", "icloud", "prime", "starter", "professional", "enterprise", "team", "trial", "free trial",
    "hosting", "domain", "license", "licence", "seat", "service fee", "monthly fee", "annual fee", "access fee",
    "game pass", "season pass", "day pass", "bundle", "unlimited", "full access", "workspace", "account fee",
    "platform fee", "streaming", "per month", "per year", "/mo", "/yr", "retainer", "saas",
]
APPOINTMENT = ["appointment", "visit", "session", "copay", "therapy", "chiropr", "massage", "wellness"]
ORDERS = ["order", "marketplace", "purchase", "seller", "shipment", "delivery"]
EXCLUDED = [
    "grocer", "food", "dining", "restaurant", "retail", "shopping", "fuel", "gas", "travel", "transport", "pharmacy",
    "personal care", "home improvement", "medical", "health",
]
DESCRIPTORS = {
    "amazon prime": "Prime", "prime membership": "Prime", "icloud+": "iCloud", "icloud": "iCloud",
    "apple one": "Apple One", "kindle unlimited": "Kindle Unlimited", "youtube premium": "YouTube Premium",
    "game pass": "Game Pass", "xbox live": "Xbox Live", "playstation plus": "PlayStation Plus",
    "apple music": "Apple Music", "apple tv": "Apple TV+", "apple arcade": "Apple Arcade",
    "apple fitness": "Apple Fitness+", "disney+": "Disney+", "paramount+": "Paramount+", "google one": "Google One",
    "microsoft 365": "Microsoft 365", "office 365": "Microsoft 365", "creative cloud": "Creative Cloud",
}
SERVICE_KINDS = ["subscriptionService", "softwareOrSaaS", "mediaStreaming"]
NON_SUBSCRIPTION_KINDS = ["utilityOrBiller", "marketplace", "groceryRetailer", "restaurant", "medicalOrWellnessProvider", "transportOrTravel", "generalRetail"]

_ALL = ("memo", "category", "merchant_raw", "merchant")


def signal_text(*names: str) -> Column:
    """The folded text of those columns; a frame from ``with_signal_texts`` holds it already."""
    return folded(F.concat_ws(" ", *[F.col(n) for n in names]))


_TEXTS = {"s_all": _ALL, "s_moved": ("category", "memo", "merchant_raw", "merchant"), "s_plain": ("memo", "merchant_raw", "merchant"), "s_visit": ("memo", "category", "merchant_raw"), "s_category": ("category",), "s_memo": ("memo",)}


#: The columns that ``flags`` adds.
FLAGS = ["refund", "movement", "bill", "noise", "strong", "keyword", "appointment", "order", "excluded", "descriptor", "planned", "known"]


def flags(df: DataFrame) -> DataFrame:
    """Every predicate as a column of its name, each text folded once. Reads memo, category, merchant_raw, merchant and kind.

    A frame that holds them all already comes back as it is.
    """
    if set(FLAGS) <= set(df.columns):
        return df
    out = df.withColumns({name: signal_text(*columns) for name, columns in _TEXTS.items()})
    moved, noise = contains_any(F.col("s_moved"), MOVEMENT), signals_any(F.col("s_all"), NOISE)
    strong, category = signals_any(F.col("s_plain"), STRONG), F.lower(F.trim(F.coalesce(F.col("category"), F.lit(""))))
    out = out.withColumns(
        {
            "refund": contains_any(F.col("s_memo"), REFUND), "movement": moved, "bill": moved | signals_any(F.col("s_moved"), BILLS), "noise": noise, "strong": strong,
            "keyword": signals_any(F.col("s_all"), EXPLICIT), "appointment": signals_any(F.col("s_visit"), APPOINTMENT), "order": signals_any(F.col("s_visit"), ORDERS),
            "excluded": contains_any(F.col("s_category"), EXCLUDED), "descriptor": F.coalesce(*[F.when(F.contains(F.col("s_all"), F.lit(k)), F.lit(v)) for k, v in DESCRIPTORS.items()]),
            "planned": contains_any(F.col("s_all"), PLANNED),
        }
    )
    by_kind = F.col("kind").isin(SERVICE_KINDS) | ((F.col("kind") == "membershipRetailer") & F.col("strong"))
    known = category.isin(SERVICE_CATEGORIES) | signals_any(F.col("s_plain"), SERVICE) | F.coalesce(by_kind, F.lit(False))
    return out.withColumn("known", ~F.col("noise") & ~F.col("bill") & known).drop(*_TEXTS)


def is_debit() -> Column:
    return F.col("amount") < 0


def looks_like_refund() -> Column:
    return contains_any(signal_text("memo"), REFUND)


def is_movement() -> Column:
    """Money moved, by phrases found anywhere ("rent" is in "current")."""
    return contains_any(signal_text("category", "memo", "merchant_raw", "merchant"), MOVEMENT)


def is_bill() -> Column:
    return is_movement() | signals_any(signal_text("category", "memo", "merchant_raw", "merchant"), BILLS)


def is_noise() -> Column:
    return signals_any(signal_text(*_ALL), NOISE)


def has_strong_wording() -> Column:
    return signals_any(signal_text("memo", "merchant_raw", "merchant"), STRONG)


def has_keyword() -> Column:
    return signals_any(signal_text(*_ALL), EXPLICIT)


def is_appointment() -> Column:
    return signals_any(signal_text("memo", "category", "merchant_raw"), APPOINTMENT)


def is_order() -> Column:
    return signals_any(signal_text("memo", "category", "merchant_raw"), ORDERS)


def is_excluded_category() -> Column:
    return contains_any(signal_text("category"), EXCLUDED)


def is_known_service() -> Column:
    """PRD-06; reads the merchant's ``kind`` too."""
    by_kind = F.col("kind").isin(SERVICE_KINDS) | ((F.col("kind") == "membershipRetailer") & has_strong_wording())
    wording = signals_any(signal_text("memo", "merchant_raw", "merchant"), SERVICE)
    category = F.lower(F.trim(F.coalesce(F.col("category"), F.lit("")))).isin(SERVICE_CATEGORIES)
    return ~is_noise() & ~is_bill() & (category | wording | F.coalesce(by_kind, F.lit(False)))


def descriptor() -> Column:
    """The label of the first phrase found, else null (PRD-12)."""
    text = signal_text(*_ALL)
    return F.coalesce(*[F.when(F.contains(text, F.lit(phrase)), F.lit(label)) for phrase, label in DESCRIPTORS.items()])
