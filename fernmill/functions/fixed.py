"""Word lists, patterns and constants that results depend on.

Patterns are Java regular expressions without flags; ``rx`` adds them.
"""

from __future__ import annotations

DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
SHORT_DAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
DAY_FORMS = {
    "monday": ["mondays", "monday", "mon"],
    "tuesday": ["tuesdays", "tuesday", "tues", "tue"],
    "wednesday": ["wednesdays", "wednesday", "wed"],
    "thursday": ["thursdays", "thursday", "thurs", "thur", "thu"],
    "friday": ["fridays", "friday", "fri"],
    "saturday": ["saturdays", "saturday", "sat"],
    "sunday": ["sundays", "sunday", "sun"],
}

STALE_AFTER_DAYS = 21
DROP_AFTER_DAYS = 90
HISTORY_DAYS = 365
FEED_VERSION = 19
VISUAL_VERSION = 5
LOGO_VERSION = 3
MIN_TEXT_CONFIDENCE = 0.82
MIN_VISUAL_CONFIDENCE = 0.9
LEAST_ASSET, MOST_ASSET = 2_000, 4_000_000
NEW_DEAL_DAYS = 7
EARTH_MILES = 3958.8

TAGS = {
    "percent_off": r"\b(?:\d{1,3}\s*)?%\s*off\b|\b\d{1,3}\s*percent\s*off\b|\bhalf\s+price\b|\b1/2\s*off\b",
    "dollar_amount": r"\$\s?\d+(?:\.\d{2})?|\b\d+(?:\.\d{2})?\s*dollars?\b",
    "bogo": r"\b(?:bogo|buy\s+one(?:,?\s+get\s+one)?|two\s+for|2\s+for|2-4-1)\b",
    "happy_hour": r"\b(?:happy|social)\s+hour\b|\blate\s+night\b",
    "weekday_special": r"\b(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|weekday|weekend|daily|all\s+day|taco\s+tuesday|wine\s+wednesday|brunch)\b",
    "free": r"\bfree\b|\bcomplimentary\b",
    "deal_language": r"\b(?:deal|deals|special|specials|discount|coupon|promo|promotion|offer|reward|rewards|limited\s+time|save|savings|starting\s+at)\b",
}
NOISE = [
    r"^(skip to|copyright|privacy policy|terms|accessibility|do not sell)",
    r"^(facebook|instagram|twitter|x|youtube|tiktok|home|menu|menus|order|order online|reserve a table|book a table|contact us|careers|gallery|directions)$",
    r"\b(?:cookie preferences|privacy policy|powered by|yelp rating|read more|grubhub|doordash|uber eats|postmates|nutritional information|party trays|at your grocer|your cart is empty)\b",
]
#: Case matters in this one: a first name and an initial.
NOISE_NAME = r"^[A-Z][a-z]+\s+[A-Z]\.$"
LOW_VALUE_SUMMARY = (
    r"^(?:fountain valley coupon!?|happy hour specials|lunch specials|dinner specialties|all dinners include|our entire menu is available|corkage fee|add chicken|add salad|add soup|"
    r"book mini golf|food & drinks|chef-driven|playground menus)"
)
PROMO_CONTEXT = (
    r"\b(?:off|free|bogo|2-4-1|buy one|half price|happy hour|social hour|special|specials|deal|deals|coupon|limited time|starting at|all day|weekday|weekend|taco tuesday|wine wednesday|"
    r"kids eat free|with purchase|not valid|valid with coupon|available carry out|dine in only|each)\b"
)
VALIDITY_CONTEXT = (
    r"\b(?:happy hour|social hour|daily|every day|all day|weekday|weekend|monday|tuesday|wednesday|thursday|friday|saturday|sunday|mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun|am|pm|valid|"
    r"dine in|carry out|coupon|limited time|after|before|holidays)\b"
)
STARTS_OFFER = r"^(?:free|happy hour|taco tuesday|wine wednesday|kids eat free|meal deals|lunch specials|daily specials)\b"
TIME_RANGE = r"\b(\d{1,2})(?::(\d{2}))?\s*(am|pm)?\s*(?:-|to|thru|through|until|–|—)\s*(\d{1,2})(?::(\d{2}))?\s*(am|pm|close)\b"
FOOD = (
    r"\b(?:app|apps|appetizer|bite|brunch|breakfast|lunch|dinner|meal|taco|tacos|pizza|wing|wings|burger|sandwich|salad|pasta|chicken|steak|fish|seafood|soup|dessert|fries|entree|platter|combo|"
    r"soda|meatloaf|spaghetti|prime rib|nachos|calamari|sliders)\b"
)
DRINK = (
    r"\b(?:beer|beers|wine|wines|vino|cocktail|cocktails|margarita|margaritas|martini|martinis|drink|drinks|bar|well|draft|pint|pints|mug|mugs|pitcher|pitchers|sangria|tequila|vodka|whiskey|"
    r"bourbon|beverage)\b"
)
NOT_DINING = r"\b(?:t-?shirts?|hoodies?|apparel|merch(?:andise)?|gift\s*cards?|free\s+shipping|shipping\s+on|subscription\s+orders?|copyright|all\s+rights\s+reserved)\b|(?:©|&copy;)"
CONCRETE = (
    r"\b(?:off|free|bogo|buy\s+one|half\s+price|happy\s+hour|hoppy\s+hour|social\s+hour|specials?|deals?|coupon|promo(?:tion)?|value\s+menu|meal\s+deal|kids\s+eat)\b|\b(?:only|just)\s+\$\s*\d"
)
EXPLICIT_DISCOUNT = r"\b(?:off|coupon|limited time|starting at|happy hour|2-4-1|half price|with purchase|kids eat free)\b"
NAMED_SPECIAL = (
    r"\b(?:slice\s+of\s+the\s+day|(?:mon(?:day)?|tue(?:sday)?|wed(?:nesday)?|thu(?:rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)\s+(?:special|[a-z]+)|"
    r"[a-z]+\s+(?:mon(?:day)?|tue(?:sday)?|wed(?:nesday)?|thu(?:rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?))\b"
)
VARIANT = r"\b(?:mon(?:day)?|tue(?:sday)?|wed(?:nesday)?|thu(?:rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?|breakfast|brunch|lunch|dinner|late\s+night)\b"
COMPARISON_PRICE = r"\b(?:regularly|normally|originally|reg(?:ular)?\.?\s*price|was)\s*(?:priced\s+at\s*)?\$\s*\d+(?:\.\d{1,2})?"
SIGNATURE_STOP = ["a", "an", "and", "deal", "deals", "drink", "drinks", "food", "foods", "menu", "offer", "offers", "special", "specials", "the"]
PROMO_SIGNAL = (
    r"\b(?:happy\s*hour|daily specials?|weekly specials?|weekday specials?|specials?|deals?|promotions?|coupons?|bogo|buy one|get one|half price|percent off|\d{1,3}%\s*off|taco tuesday|wine wednesday|"
    r"thirsty thursday|kids eat free|with purchase|all day)\b"
)
VALUE_SIGNAL = r"(?:\$\s*\d|\d{1,3}%\s*off|\b(?:free|bogo|half price|happy\s*hour|with purchase)\b|\bbuy\s+one\b.{0,50}\bget\s+one\b)"
NOISE_SUMMARY = (
    r"^(?:about|contact|home|menu|order|order now|order online|our story|visit us|view menu|full menu|get coupon|print|sign up|rewards?|instagram|facebook|main content|what.s included|expires?\b)"
)
RESTRICTION = r"\b(?:only|not valid|with purchase|required|restrictions?)\b"
VISUAL_HINT = (
    r"\b(?:happy[\s_-]*hour|daily[\s_-]*specials?|weekly[\s_-]*specials?|weekday[\s_-]*(?:specials?|lunch|dinner)|lunch[\s_-]*specials?|dinner[\s_-]*specials?|promotions?|coupons?|deals?|"
    r"specials?[\s_-]*menu)\b"
)
VISUAL_NOISE = (
    r"\b(?:logo|favicon|icon|avatar|profile|social|instagram|facebook|twitter|tripadvisor|yelp|opentable|delivery|hero|banner|gallery|interior|exterior|team|privacy|terms|conditions|accessibility|"
    r"cookies?|policy|careers?|franchis(?:e|ing))\b"
)
DIRECT_VISUAL = r"\.(?:jpe?g|png|webp|gif|pdf)(?:$|[?#])"
SPECIAL_LINK = (
    r"\b(?:happy[\s_-]*hour|daily[\s_-]*specials?|weekday[\s_-]*specials?|weekly[\s_-]*specials?|food[\s_-]*specials?|drink[\s_-]*specials?|restaurant[\s_-]*specials?|lunch[\s_-]*specials?|"
    r"weekday[\s_-]*(?:lunch|dinner)|team[\s_-]*specials?|promotions?|coupons?|deals?)\b"
)
WEAK_LINK = r"\bspecials?\b"
WEAK_LINK_NOT = r"menu|catering|gift"
PAGE_PROMO = r"(?:\d{1,3}%\s*off|\b(?:happy\s*hour|daily\s*specials?|weekday\s*specials?|bogo|buy\s+one|get\s+one|half\s*price|kids\s+eat\s+free)\b)"
HUB_LINK = r"menus?[\s_-]*(?:and|&)?[\s_-]*specials?|specials?[\s_-]*menu"
KNOWN_PATHS = ["/happy-hour", "/specials", "/daily-specials", "/dailyspecials", "/weekday-specials", "/weekday-lunch", "/deals", "/promotions"]
BLOCKED_HOSTS = ["facebook.com", "instagram.com", "linktr.ee", "opentable.com", "toasttab.com", "yelp.com"]
BAD_ASSET = r"(?:qr|qrcode|cart|shopping|table[-_ ]?setting|menu[-_ ]?item|food[-_ ]?photo)"
CHAIN_HOST = r"(?:^|\.)(?:kfc|tacobell|wienerschnitzel|rubios|ikea|pollyspies)\.com$"
HOST_COLORS = {"anatoliamediterranean.com": "#173f73", "beachwoodpizza.com": "#09a1bf"}
CHAINS = (
    r"\b(?:applebee'?s|arby'?s|baja fresh|blaze pizza|burger king|carl'?s jr|chick-fil-a|chipotle|denny'?s|domino'?s|el pollo loco|five guys|habit burger|ihop|in-n-out|jack in the box|jersey mike'?s|"
    r"kfc|little caesars|mcdonald'?s|panda express|panera|papa john'?s|pizza hut|popeyes|raising cane'?s|round table pizza|rubio'?s|shake shack|sonic|starbucks|subway|taco bell|wendy'?s|"
    r"wienerschnitzel|wingstop)\b"
)
#: Magic bytes by type, in hexadecimal, at the start of a file.
MAGIC = {"application/pdf": "25504446", "image/png": "89504E470D0A1A0A", "image/jpeg": "FFD8FF", "image/gif": "474946383761 474946383961", "image/x-icon": "00000100"}
VISUAL_TYPES = ["image/jpeg", "image/png", "image/webp", "image/gif", "application/pdf"]
EXTENSIONS = {"image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/x-icon": "ico", "image/vnd.microsoft.icon": "ico", "image/webp": "webp"}


def rx(pattern: str) -> str:
    """The pattern ignoring the case of ASCII letters, which all patterns here are made of.

    Boundaries are Unicode's by default; white space has been normalized to spaces.
    """
    return "(?i)" + pattern
