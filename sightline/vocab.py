"""Word lists, tables, patterns and message texts that results depend on."""

# --- Severities -------------------------------------------------------------------
CRITICAL = "critical"
MAJOR = "major"
MINOR = "minor"
SEVERITIES = (CRITICAL, MAJOR, MINOR)

SEVERITY_COLORS = {"critical": "red", "major": "yellow", "minor": "blue"}
SEVERITY_EMOJI = {"critical": "🔴", "major": "🟡", "minor": "🔵"}
DEFAULT_COLOR = "white"
DEFAULT_EMOJI = "⚪"

# code | level | success criterion | criterion name | impact
SEVERITY_ROWS = [
    tuple(line.split("|"))
    for line in """
IMG_MISSING_ALT|critical|1.1.1|Non-text Content|Screen reader users cannot understand image content
LINK_IMG_MISSING_ALT|critical|1.1.1|Non-text Content|Screen reader users cannot understand link purpose
FORM_CONTROL_NO_LABEL|critical|1.3.1|Info and Relationships|Screen reader users cannot identify form fields
LINK_NO_TEXT|critical|2.4.4|Link Purpose (In Context)|Screen reader users cannot understand link destination
BUTTON_NO_TEXT|critical|4.1.2|Name, Role, Value|Screen reader users cannot understand button purpose
MISSING_LANG|critical|3.1.1|Language of Page|Screen readers may mispronounce content
TABLE_NO_HEADERS|critical|1.3.1|Info and Relationships|Screen reader users cannot understand table structure
ARIA_HIDDEN_FOCUSABLE|critical|4.1.2|Name, Role, Value|Keyboard users can focus invisible elements
LOW_CONTRAST|major|1.4.3|Contrast (Minimum)|Users with low vision may not be able to read text
VIDEO_NO_CAPTIONS|major|1.2.2|Captions (Prerecorded)|Deaf users cannot access video audio content
AUDIO_NO_TRANSCRIPT|major|1.2.1|Audio-only and Video-only|Deaf users cannot access audio content
INVALID_ARIA_ROLE|major|4.1.2|Name, Role, Value|Assistive technology may not interpret element correctly
MISSING_MAIN|major|1.3.1|Info and Relationships|Screen reader users cannot easily navigate to main content
AUTOPLAY_NO_CONTROLS|major|1.4.2|Audio Control|Users cannot stop unwanted audio
HEADING_ORDER|minor|1.3.1|Info and Relationships|May confuse screen reader users navigating by headings
INVALID_LANG|minor|3.1.1|Language of Page|Screen readers may not properly switch language
NO_SKIP_LINK|minor|2.4.1|Bypass Blocks|Keyboard users must tab through all navigation
BROKEN_SKIP_LINK|minor|2.4.1|Bypass Blocks|Skip link does not work as expected
MULTIPLE_H1|minor|1.3.1|Info and Relationships|May confuse screen reader users about page structure
TABLE_NO_CAPTION|minor|1.3.1|Info and Relationships|Screen reader users may not understand table purpose
MISSING_TITLE|minor|2.4.2|Page Titled|Users may not identify page purpose in tabs/bookmarks
""".strip().splitlines()
]

# --- Vocabularies -----------------------------------------------------------------
ARIA_ROLES = list(dict.fromkeys("""
banner complementary contentinfo form main navigation region search
article cell columnheader definition directory document feed figure group heading img list listitem math
none note presentation row rowgroup rowheader separator table term toolbar tooltip
alert alertdialog button checkbox combobox dialog gridcell link listbox log marquee menu menubar
menuitem menuitemcheckbox menuitemradio option progressbar radio radiogroup scrollbar searchbox slider spinbutton
status switch tab tablist tabpanel textbox timer tree treegrid treeitem
command composite input landmark range roletype section sectionhead select structure widget window
application generic
""".split()))

LANGUAGE_CODES = """
aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz
ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik
io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml
mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd
se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi
vo wa wo xh yi yo za zh zu
""".split()

NAMED_COLORS = dict(pair.split("=") for pair in """
white=#ffffff black=#000000 red=#ff0000 green=#008000 blue=#0000ff yellow=#ffff00 cyan=#00ffff
magenta=#ff00ff gray=#808080 grey=#808080 silver=#c0c0c0 maroon=#800000 olive=#808000 lime=#00ff00
aqua=#00ffff teal=#008080 navy=#000080 fuchsia=#ff00ff purple=#800080 orange=#ffa500 pink=#ffc0cb
""".split())

CONTRAST_THRESHOLDS = {"AA": 4.5, "AAA": 7.0}

UNLABELLED_INPUT_TYPES = ("hidden", "submit", "button", "image", "reset")
LEGACY_UNLABELLED_INPUT_TYPES = ("hidden", "submit", "button", "image")
BUTTON_INPUT_TYPES = ("button", "submit", "reset")
LAYOUT_TABLE_ROLES = ("presentation", "none")
CAPTION_TRACK_KINDS = ("captions", "subtitles")
FOCUSABLE_TAGS = ("a", "button", "input", "select", "textarea", "iframe")
SKIP_LINK_PATTERN = "skip.*main|skip.*content|skip.*nav|jump.*content|jump.*main"
SKIP_LINK_TARGETS = ("#main", "#content")
SKIP_LINK_WINDOW = 10

# --- Messages ---------------------------------------------------------------------
MSG_IMG_MISSING_ALT = "Image element missing descriptive alt text."
MSG_LINK_IMG_MISSING_ALT = "Link contains image(s) without alt text."
MSG_FORM_CONTROL_NO_LABEL = "Form control is missing an accessible label."
MSG_HEADING_ORDER = "Heading level jumps from h%d to h%d (may confuse screen readers)."
MSG_HEADING_ORDER_LEGACY = "Heading level jumps (may confuse screen readers)."
MSG_LOW_CONTRAST = "Low contrast ratio (%.2f:1): text may be hard to read. WCAG {level} requires at least {threshold}:1."
MSG_LINK_NO_TEXT = "Link has no accessible name (no text and no labelled content)."
MSG_MISSING_LANG = "HTML element is missing the 'lang' attribute. Screen readers use this to determine pronunciation."
MSG_INVALID_LANG = "Invalid language code '%s'. Use a valid ISO 639-1 language code."
MSG_BUTTON_NO_TEXT = "Button element has no accessible name."
MSG_INPUT_NO_TEXT = "Input type='%s' has no accessible name."
MSG_ROLE_BUTTON_NO_TEXT = "Element with role='button' has no accessible name."
MSG_MISSING_TITLE = "Page is missing a <title> element. Titles help users identify pages in tabs and bookmarks."
MSG_MISSING_MAIN = "Page is missing a <main> landmark. Screen reader users use landmarks to navigate."
MSG_MULTIPLE_H1 = "Page has %d <h1> elements. Best practice is to have one h1 per page."
MSG_MISSING_H1 = "Page is missing an <h1> element. The h1 should describe the main content of the page."
MSG_TABLE_NO_HEADERS = (
    "Data table is missing header cells (<th>). Headers help screen reader users understand table structure."
)
MSG_TABLE_NO_CAPTION = (
    "Data table is missing a caption or accessible name. Use <caption> or aria-label to describe the table."
)
MSG_TABLE_MISSING_SCOPE = (
    "Table header is missing 'scope' attribute. Use scope='col' or scope='row' to clarify header relationships."
)
MSG_INVALID_ARIA_ROLE = "Invalid ARIA role '%s'. Use a valid WAI-ARIA role."
MSG_ARIA_HIDDEN_SELF = (
    "Element with aria-hidden='true' is focusable. This creates a confusing experience for keyboard users."
)
MSG_ARIA_HIDDEN_INSIDE = (
    "Element with aria-hidden='true' contains focusable content. Keyboard users can focus invisible elements."
)
MSG_BROKEN_SKIP_LINK = "Skip link target '#%s' does not exist."
MSG_NO_SKIP_LINK = "Page has navigation but no skip link. Keyboard users must tab through all navigation."
MSG_VIDEO_NO_CAPTIONS = (
    "Video element is missing captions. Add <track kind='captions'> for deaf/hard-of-hearing users."
)
MSG_VIDEO_AUTOPLAY = "Video autoplays with sound but has no controls. Users cannot pause or mute the video."
MSG_AUDIO_AUTOPLAY = "Audio autoplays with sound but has no controls. Users cannot pause or mute the audio."

# --- Contexts that do not quote the page ---------------------------------------------
CONTEXT_HEAD = "<head>...</head>"
CONTEXT_BODY = "<body>...</body>"
CONTEXT_NAV = "<body><nav>...</nav></body>"

# --- Limits -------------------------------------------------------------------------
CONTEXT_CHARS = 200
LANG_CONTEXT_CHARS = 100
H1_CONTEXT_CHARS = 50
HEADING_SEQUENCE_LENGTH = 20
REPORT_CONTEXT_CHARS = 100
CONSOLE_CONTEXT_CHARS = 40
CONSOLE_ISSUES = 50
CONSOLE_FIXES = 10
ANCHOR_CHARS = 50
SNIPPET_CHARS = 2000
PROMPT_HTML_CHARS = 4000
CRAWL_MAX_PAGES = 200
BASIC_CRAWL_MAX_PAGES = 20

PROMPT_INTRO = (
    "You are an accessibility expert. Given the site HTML and list of issues, "
    "provide concise, actionable fixes for each issue."
)

# --- Request rates --------------------------------------------------------------------
INITIAL_RATE = 2.0
MIN_RATE = 0.1
MAX_RATE = 10.0
SLOW_SECONDS = 5.0
SLOWDOWN = 0.8
SPEEDUP = 1.1
SUCCESSES_PER_SPEEDUP = 10
RETRY_ATTEMPTS = 3
