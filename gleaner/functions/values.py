"""Word lists, patterns, defaults and message texts.

Results depend on these being exactly as they are.
"""

# Tags whose text runs on within a line.
INLINE_TAGS = [
    "a", "abbr", "b", "bdi", "bdo", "br", "cite", "code", "data", "dfn",
    "em", "i", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp",
    "small", "span", "strong", "sub", "sup", "time", "u", "var", "wbr",
]

# Element names of the HTML standard. Any other tag counts as
# "unknown" when tag paths are compared.
HTML_TAGS = [
    "a", "abbr", "acronym", "address", "applet", "area", "article", "aside",
    "audio", "b", "base", "basefont", "bdi", "bdo", "bgsound", "big", "blink",
    "blockquote", "body", "br", "button", "canvas", "caption", "center",
    "cite", "code", "col", "colgroup", "command", "data", "datalist", "dd",
    "del", "details", "dfn", "dialog", "dir", "div", "dl", "dt", "em", "embed",
    "fieldset", "figcaption", "figure", "font", "footer", "form", "frame",
    "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup",
    "hr", "html", "i", "iframe", "image", "img", "input", "ins", "isindex",
    "kbd", "keygen", "label", "legend", "li", "link", "listing", "main", "map",
    "mark", "marquee", "math", "menu", "menuitem", "meta", "meter", "nav",
    "nobr", "noembed", "noframes", "noscript", "object", "ol", "optgroup",
    "option", "output", "p", "param", "picture", "plaintext", "pre",
    "progress", "q", "rb", "rp", "rt", "rtc", "ruby", "s", "samp", "script",
    "section", "select", "slot", "small", "source", "spacer", "span", "strike",
    "strong", "style", "sub", "summary", "sup", "svg", "table", "tbody", "td",
    "template", "textarea", "tfoot", "th", "thead", "time", "title", "tr",
    "track", "tt", "u", "ul", "var", "video", "wbr", "xmp",
]

# Text rules (Java regular expressions).
WHITESPACE_RUN = r"([\t\n\f\r ]{2,}|\n|\t)"
NON_PRINTING = r"[^\x20-\x7E\x{A1}-\x{10FFFF}]"
WORD = r"[A-Za-z0-9_-]+"
ENDS_IN_PUNCTUATION = r"[!.?] ?\z"
SPACE_BEFORE_PUNCTUATION = r"[\t\n\f\r ]+([!.?])"
TRIM_CHARS = " \n\t"
CAPTION_WORDS = 20
FORMAT_TAG = r"(<rss[^>\n]*>?|<!doctype html>|<html[^>\n]*>?|<feed[^>\n]*>?)"
DAY_MARKER = "[A-Z][a-z]?"

# Defaults of the configuration.
DEFAULT_MAX_ITEMS = 5
DEFAULT_MIN_ELEMENT_WORDS = 3
DEFAULT_EXPIRY_DAYS = 180

# Schedule day markers, Monday first.
DAYS = ["M", "Tu", "W", "Th", "F", "Sa", "Su"]

# Messages about the response of a site.
MSG_NULL_PAGE = "could not read the HTML document in order to parse it"
MSG_403 = "We don't have permission to get links from this website. Check your configuration."
MSG_404 = "We couldn't find the website at this URL. Maybe it changed?"
MSG_429 = "We were rate limited. You should change your configuration to check this site less frequently."
MSG_400 = "Got a %s error sending the scrape request—check your config."
MSG_5XX = "Got a %s error sending the scrape request—check manually to see if this is temporary."
MSG_600 = "Unexpected status code %s. Try visiting the site manually."

# Messages of the detectors.
MSG_NO_FORMAT = "could not detect a format for the page"
MSG_NO_MATCH = (
    "The link selector you configured for %s did not match any HTML elements. "
    "Try the request from your browser or curl and check for any issues."
)
MSG_BODY = "cannot extract a caption from an HTML body element"
MSG_BAD_LINK_URL = "Cannot parse the link URL <nil>"
MSG_NO_LINK_SELECTOR = "Could not parse the link selector."
MSG_AMBIGUOUS_LINK = "The link selector is ambiguous, so we couldn't parse any link items."
MSG_NO_LINK = "There are no links in the list item. Double-check your configuration."
MSG_NOT_A_LINK = "The link selector does not match a link but rather %s."
AMBIGUOUS_CAPTION = "[Missing caption due to ambiguous selector]"
MSG_CUT_PAGE = "This page is longer than %s bytes. We only read its beginning."
MSG_BAD_FEED = "cannot parse the feed: the document is not well-formed"

# Messages of the configuration checks.
ERR_URL_MISSING = "the link source must include a URL"
ERR_URL_INVALID = "can't parse the link source URL"
ERR_NAME_BLANK = "the link source name can't be blank"
ERR_REPEATED_KEY = "another link source has the same key"
ERR_MAX_ITEMS = "invalid maxItems: must be a positive integer"
ERR_MIN_WORDS = "invalid minElementWords: must be a positive integer"
ERR_ITEM_SELECTOR = "cannot parse itemSelector"
ERR_CAPTION_SELECTOR = "cannot parse captionSelector"
ERR_LINK_SELECTOR = "cannot parse linkSelector"
ERR_NEEDS_LINK_SELECTOR = (
    "to detect captions manually, you must provide a link selector, "
    "item selector, and caption selector"
)
ERR_ITEM_AND_CAPTION = (
    "if you provide an item selector, you must provide a caption selector and vice versa"
)
ERR_EXPIRY = "can't parse the link expiry as an integer"
ERR_STORAGE = "user-provided config does not include a storage path"
ERR_SCHEDULE_PARTS = (
    "notification schedules must include days and an hour, "
    'separated by a space, such as "MWF 12"'
)
ERR_SCHEDULE_DAY = "not a valid notification schedule day"
ERR_SCHEDULE_HOUR = "cannot convert the hour of a notification schedule into an integer"

# Wording and layout of the digest bodies.
NO_LINKS = "We could not find any links for this site. "
HTML_HEAD = "<html>\n<head>\n</head>\n<body>\n\t<p>Your link digest found the following links.</p>\n\t"
HTML_SECTION = "\t\t<h2>%s</h2>\n\t\t<p>%s</p>\n\t\t<ul>\n\t\t"
HTML_ITEM = '\t\t\t<li>%s (<a href="%s">here</a>)</li>\n\t\t'
HTML_SECTION_END = "\t\t</ul>\n\t"
HTML_TAIL = "</body>\n</html>"
TEXT_SECTION = "%s\n\n%s\n"
TEXT_ITEM = "- %s\n  %s\n\n"
ITEM_IN_BODY = r'(<li>.*\(<a href=".*">.*</a>\)</li>)'
