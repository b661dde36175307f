"""Word lists, thresholds and regular expressions of the measurements, in Java's dialect.

``(?U)`` makes \\w, \\s, \\d and \\b follow Unicode, ``(?d)`` leaves line ends to \\n alone.
"""

# Lists and thresholds that results depend on.
ABBREVIATIONS = ["Dr.", "Mr.", "Mrs.", "Ms.", "St.", "p.m.", "a.m.", "e.g.", "i.e."]
EXPANDED = [
    "do not", "does not", "did not", "is not", "are not", "was not", "were not", "cannot", "can not", "will not",
    "would not", "should not", "could not", "have not", "has not", "had not", "it is", "that is", "there is", "I am",
    "you are", "we are", "they are", "I will", "we will",
]
CONTRACTED_ENDINGS = ["t", "s", "re", "ll", "ve", "d", "m"]
HEDGE_PHRASES = [
    "just", "i think", "maybe", "perhaps", "sorry to", "a bit", "kind of", "sort of", "possibly", "if that works",
    "no rush", "whenever you get a chance",
]
ASK_PHRASES = ["can you", "could you", "would you", "please", "let me know", "need you to", "send me", "confirm"]
ASK_DEADLINES = ["monday", "tuesday", "wednesday", "thursday", "friday", "eod", "end of"]
IMPERATIVES = ["send", "check", "confirm", "review", "let", "call", "ping", "see", "take", "hold", "drop", "add", "move", "use", "need"]
SIGNOFFS = ["best", "thanks", "thank you", "cheers", "regards", "best regards", "talk soon", "sincerely", "all the best", "appreciate it"]
CONSUMER_DOMAINS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com", "me.com", "aol.com", "proton.me"]
VENDOR_HINTS = ["billing", "support", "invoices", "noreply", "accounts"]
MACHINE_MARKERS = [
    "google meet joining info", "join with google meet", "video call link:", "zoom.us/j/", "microsoft teams meeting",
    "join the meeting now", "when\nwhere\nwho", "add to calendar", "rsvp to this invitation",
]
AUTO_HEADERS = ["auto-submitted", "x-autoreply", "x-autorespond"]
WEEKDAYS_MONTHS = [
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "january", "february", "march",
    "april", "may", "june", "july", "august", "september", "october", "november", "december", "mon", "tue", "wed",
    "thu", "fri", "sat", "sun", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
]
NOT_NAMES = [
    "team", "all", "everyone", "folks", "hi", "hello", "hey", "thanks", "regards", "cheers", "good", "morning",
    "afternoon", "evening", "sincerely",
]
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
DIMENSIONS = ["length", "hedging", "opener", "signoff", "ask_placement", "structure", "punctuation", "contractions", "formality", "closing_offer"]
DIRECTIONS = ["reduce", "increase"]
STATUSES = ["pending", "matched", "ambiguous"]
DEDUPE_SIMILARITY, SHINGLE_WORDS, TERSE_WORDS, LINK_ONLY_WORDS = 0.70, 5, 15, 4
REGISTER_MESSAGES, CORPUS_MESSAGES = 8, 12
UNSEEN_FREQUENCY, LEXICON_SIZE, LEXICON_COUNT = 1e-7, 15, 3
EXEMPLARS, TERSE_EXEMPLARS, NON_ASCII_SHARE = 4, 3, 0.15
MATCH_SIMILARITY, REWRITE_SIMILARITY, RETENTION_DAYS, PAIR_SIMILARITY = 0.5, 0.25, 30, 0.3
PROMOTION_DRAFTS, PASS_SHARE, BASELINE_ROWS = 2, 0.7, 20000


# Regular expressions that results depend on, built from the lists above.
def any_of(items: list[str]) -> str:
    """Alternation of literal strings."""
    return "(?:" + "|".join(x.replace(".", "\\.") for x in items) + ")"


WORD = "[A-Za-z']+"
BLANK = "(?U)\\s+"
# The cheapest condition first: most characters are no sentence end.
SENTENCE_BREAK = "(?U)(?<=[.!?])" + "".join(f"(?<!\\b{x.replace('.', chr(92) + '.')})" for x in ABBREVIATIONS) + "\\s+(?=[A-Z0-9])"
PARAGRAPH_BREAK = "(?U)\\n\\s*\\n"
EXPANDED_FORM = "(?iuU)\\b" + any_of(EXPANDED) + "\\b"
CONTRACTED_FORM = "(?iuU)\\b\\w+'" + any_of(CONTRACTED_ENDINGS) + "\\b"
EMOJI = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}]"
EM_DASH, ELLIPSIS = "[\u2014\u2013]|--", "\\.\\.\\.|\u2026"
HEDGE = "(?iuU)\\b" + any_of(HEDGE_PHRASES) + "\\b"
ASK = "(?iuU)\\?|\\b(?:" + any_of(ASK_PHRASES) + "|by " + any_of(ASK_DEADLINES) + ")\\b"
IMPERATIVE = "(?iuU)^" + any_of(IMPERATIVES) + "\\b(?!-)"
BULLET_LINE = "(?U)^\\s*[-*\u2022]\\s+"

QUOTED = (
    "(?Udm)(?:^On .{0,200}\\bwrote:\\s*$"
    "|^-{2,}\\s*(?iu:Original Message)\\s*-{2,}\\s*$"
    "|^_{10,}\\s*$"
    "|^From:\\s.+\\nSent:\\s.+$"
    "|^\\s*>)(?s:.*)"
)
SIGNATURE_MARK = "(?Udm)^--\\s?$(?s:.*)"
MOBILE_FOOTER = "(?iuUdm)^\\s*(?:Sent from my \\w+|Get Outlook for \\w+|Sent via \\w+).*$(?s:.*)"
CONTACT = "(?iuU)\\+?\\d[\\d\\s().-]{7,}\\d|\\b[\\w.+-]+@[\\w-]+\\.\\w+\\b|\\b[\\w-]+\\.(?:com|net|org|io|co)\\b|\\|"
URL = "(?U)https?://\\S+|\\bwww\\.\\S+"
TRACKED_URL = "(?U)https?://(?:www\\.)?google\\.com/url\\?q=([^&\\s]+)\\S*"
URL_SCHEME = "(?U)\\bhttps?://"
LIST_ITEM = "(?U)(?:[-*\u2022]|\\d+[.)])\\s"

EMAIL_ADDRESS = "(?U)\\b[\\w.+-]+@[\\w-]+\\.[\\w.]+\\b"
AMOUNT = "(?U)\\$\\s?\\d[\\d,]*(?:\\.\\d{2})?\\b"
PHONE = "(?U)(?<!\\w)\\+?\\d[\\d\\s().-]{8,}\\d(?!\\w)"
STREET = "(?U)\\b\\d{1,5}\\s+[A-Z][a-z]+\\s+(?:Street|St|Avenue|Ave|Road|Rd|Blvd)\\b"
