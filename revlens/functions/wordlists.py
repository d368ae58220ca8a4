"""Fixed word lists and keyword tables."""

from __future__ import annotations

# The English stopwords of the common public corpus list.
ENGLISH_STOPWORDS = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours
    yourself yourselves he him his himself she she's her hers herself it it's its
    itself they them their theirs themselves what which who whom this that that'll
    these those am is are was were be been being have has had having do does did
    doing a an the and but if or because as until while of at by for with about
    against between into through during before after above below to from up down in
    out on off over under again further then once here there when where why how all
    any both each few more most other some such no nor not only own same so than too
    very s t can will just don don't should should've now d ll m o re ve y ain aren
    aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven
    haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't
    shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
    """.split()
)

# Words removed on top of the stopwords when cleaning reviews.
REVIEW_STOPWORDS = (
    "app", "nz", "one", "vodafone", "would", "could",
    "get", "im", "ive", "dont", "cant", "wont",
)

# Words left out of the word-frequency tables.
FREQUENCY_STOPWORDS = (
    "app", "one", "nz", "vodafone", "phone", "mobile",
    "use", "get", "would", "could", "time", "now", "just",
    "even", "also", "back", "still", "much", "well", "like",
)

# Categories and their keywords, in report order.
ISSUE_TAXONOMY: dict[str, list[str]] = {
    "Login/Authentication Issues": [
        "login", "log in", "sign in", "signin", "cant log", "can't log", "password", "locked out",
        "authentication", "verify", "verification", "forgot password", "reset password",
        "account access",
    ],
    "App Crashes/Freezing": [
        "crash", "crashes", "freeze", "frozen", "hang", "stuck", "loading forever", "stops working",
        "force close", "unresponsive", "black screen", "white screen", "not responding",
    ],
    "Slow Performance": [
        "slow", "lag", "laggy", "sluggish", "takes forever", "speed", "performance", "loading time",
        "wait", "waiting",
    ],
    "Billing/Charging Issues": [
        "charge", "charged", "bill", "billing", "payment", "money", "fee", "cost", "expensive",
        "overcharge", "wrong charge", "unexpected charge", "double charge", "incorrect bill",
    ],
    "Auto Top-up Problems": [
        "auto topup", "auto top up", "automatic topup", "auto payment", "keep charging",
        "stop charging", "deducted", "taken money",
    ],
    "Data Usage Issues": [
        "data", "usage", "data usage", "using data", "data gone", "data disappear", "data vanish",
        "eating data", "data drain",
    ],
    "Balance/Credit Issues": [
        "balance", "credit", "top up", "topup", "recharge", "reload", "cant see balance",
        "balance missing", "credit missing",
    ],
    "Missing Features": [
        "missing", "removed", "gone", "disappeared", "unavailable", "cant find", "can't find",
        "where is", "no longer", "taken away",
    ],
    "Feature Not Working": [
        "not working", "doesnt work", "doesn't work", "broken", "error", "failed", "fails",
        "wont work", "won't work", "cant use",
    ],
    "User Interface Problems": [
        "interface", "ui", "design", "layout", "confusing", "complicated", "hard to use", "difficult",
        "cant navigate", "poor design",
    ],
    "Update Problems": [
        "update", "updated", "new version", "latest version", "upgrade", "after update",
        "since update", "broken after", "worse after",
    ],
    "Customer Service Issues": [
        "support", "service", "help", "customer service", "no help", "response", "reply", "contact",
        "cant contact", "no response", "unhelpful", "rude", "poor service",
    ],
    "Network/Connection Issues": [
        "network", "connection", "signal", "coverage", "internet", "wifi", "connect", "disconnect",
        "no service", "poor signal",
    ],
    "Installation/Compatibility": [
        "install", "download", "wont install", "cant install", "compatible", "compatibility", "phone",
        "device", "version",
    ],
    "Account Issues": [
        "account", "profile", "settings", "cant change", "locked", "suspended", "closed",
        "cant access account",
    ],
}

# The compact table with seven categories.
COMPACT_TAXONOMY: dict[str, list[str]] = {
    "Login/Authentication": [
        "login", "log in", "sign in", "signin", "cant log", "can't log", "password", "account",
    ],
    "App Performance": ["crash", "freeze", "frozen", "hang", "stuck", "loading", "slow", "lag"],
    "Billing/Charges": [
        "charge", "bill", "billing", "payment", "money", "fee", "cost", "expensive", "price",
    ],
    "Data/Usage": ["data", "usage", "balance", "top up", "topup", "credit", "recharge"],
    "Features/UI": ["missing", "removed", "gone", "unavailable", "interface", "design"],
    "Customer Service": ["support", "service", "help", "customer", "response", "reply"],
    "Network/Connection": ["network", "connection", "signal", "coverage", "internet", "wifi"],
}

# Fixed values of the published valence rules (Hutto & Gilbert 2014): words that
# negate a following sentiment word, and words that strengthen or weaken it. Only
# spellings that survive cleaning (no apostrophes or hyphens) are listed.
NEGATORS = tuple(
    """
    aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt
    mightnt mustnt neither neednt never none nope nor not nothing nowhere oughtnt
    shant shouldnt uhuh wasnt werent without wont wouldnt rarely seldom despite
    """.split()
)
BOOSTERS_UP = tuple(
    """
    absolutely amazingly awfully completely considerably decidedly deeply effing
    enormously entirely especially exceptionally extremely fabulously flipping
    flippin fricking frickin frigging friggin fully fucking greatly hella highly
    hugely incredibly intensely majorly more most particularly purely quite really
    remarkably so substantially thoroughly totally tremendously uber unbelievably
    unusually utterly very
    """.split()
)
BOOSTERS_DOWN = tuple(
    """
    almost barely hardly kinda kindof less little marginally occasionally partly
    scarcely slightly somewhat sorta sortof
    """.split()
)
