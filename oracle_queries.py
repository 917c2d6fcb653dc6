"""Reference SQL for the registered queries, written from the rule definitions, not from the engine.

The plain pages are read with regular expressions. For the page sets derived from them, the SQL states
the expected issues of every variant and joins them to the pages.
"""

from __future__ import annotations

from sightline.plans.corpora import EDITS, SNIPPETS

S = "'"


def q(text: str | None) -> str:
    return "NULL" if text is None else S + text.replace(S, S + S) + S


ALT = "Image element missing descriptive alt text."
LINK_ALT = "Link contains image(s) without alt text."
LABEL = "Form control is missing an accessible label."
LINK = "Link has no accessible name (no text and no labelled content)."
BUTTON = "Button element has no accessible name."
ROLE_BUTTON = "Element with role='button' has no accessible name."
CONTRAST = "Low contrast ratio (%s:1): text may be hard to read. WCAG AA requires at least 4.5:1."
MAIN = "Page is missing a <main> landmark. Screen reader users use landmarks to navigate."
T1 = "<table><tr><td>1</td></tr><tr><td>2</td></tr></table>"
HIDDEN = "Element with aria-hidden='true' "

# variant, position among the page's issues, analyzer, code, message, context (null: taken from the page)
EXPECTED = [
    (1, 0, "alt_text", "IMG_MISSING_ALT", ALT, '<img src="logo.png"/>'),
    (2, 0, "alt_text", "IMG_MISSING_ALT", ALT, '<img src="i.png"/>'),
    (2, 1, "alt_text", "LINK_IMG_MISSING_ALT", LINK_ALT, '<a href="/x"><img src="i.png"/></a>'),
    (3, 0, "alt_text", "IMG_MISSING_ALT", ALT, '<img src="b.png" alt="  "/>'),
    (4, 0, "form_labels", "FORM_CONTROL_NO_LABEL", LABEL, '<input type="text" id="name"/>'),
    (6, 0, "heading_order", "HEADING_ORDER",
     "Heading level jumps from h1 to h3 (may confuse screen readers).", "sequence: [1, 3, 6]"),
    (7, 0, "contrast", "LOW_CONTRAST", CONTRAST % "4.48",
     '<p style="color: #777777; background-color: #ffffff">t</p>'),
    (8, 0, "contrast", "LOW_CONTRAST", CONTRAST % "2.85",
     '<p style="color:hsl(0, 0%, 60%);background:rgb(255, 255, 255)">t</p>'),
    (9, 0, "link_text", "LINK_NO_TEXT", LINK, '<a href="/e"></a>'),
    (9, 1, "link_text", "LINK_NO_TEXT", LINK, '<a name="n"></a>'),
    (10, 0, "button", "BUTTON_NO_TEXT", BUTTON, "<button></button>"),
    (11, 0, "button", "BUTTON_NO_TEXT", BUTTON, '<button role="button"></button>'),
    (11, 1, "button", "BUTTON_NO_TEXT", ROLE_BUTTON, '<button role="button"></button>'),
    (12, 0, "button", "BUTTON_NO_TEXT", "Input type='button' has no accessible name.", '<input type="button"/>'),
    (12, 1, "button", "BUTTON_NO_TEXT", "Input type='submit' has no accessible name.",
     '<input type="submit" value=""/>'),
    (13, 0, "button", "BUTTON_NO_TEXT", ROLE_BUTTON, '<div role="button"></div>'),
    (14, 1, "document_structure", "MULTIPLE_H1",
     "Page has 2 <h1> elements. Best practice is to have one h1 per page.", None),
    (15, 1, "table", "TABLE_NO_HEADERS",
     "Data table is missing header cells (<th>). Headers help screen reader users understand table structure.", T1),
    (15, 2, "table", "TABLE_NO_CAPTION",
     "Data table is missing a caption or accessible name. Use <caption> or aria-label to describe the table.", T1),
    (16, 1, "table", "TABLE_MISSING_SCOPE",
     "Table header is missing 'scope' attribute. Use scope='col' or scope='row' to clarify header relationships.",
     "<th>A</th>"),
    (18, 1, "aria", "INVALID_ARIA_ROLE", "Invalid ARIA role 'foobar'. Use a valid WAI-ARIA role.",
     '<div role="foobar">x</div>'),
    (19, 1, "aria", "ARIA_HIDDEN_FOCUSABLE",
     HIDDEN + "is focusable. This creates a confusing experience for keyboard users.",
     '<button aria-hidden="true">H</button>'),
    (19, 2, "aria", "ARIA_HIDDEN_FOCUSABLE",
     HIDDEN + "contains focusable content. Keyboard users can focus invisible elements.",
     '<div aria-hidden="true"><a href="/q">q</a></div>'),
    (20, 0, "skip_link", "BROKEN_SKIP_LINK", "Skip link target '#nonexistent' does not exist.",
     '<a href="#nonexistent">Skip to main</a>'),
    (21, 0, "skip_link", "NO_SKIP_LINK",
     "Page has navigation but no skip link. Keyboard users must tab through all navigation.",
     "<body><nav>...</nav></body>"),
    (22, 1, "media", "VIDEO_NO_CAPTIONS",
     "Video element is missing captions. Add <track kind='captions'> for deaf/hard-of-hearing users.",
     '<video src="v.mp4"></video>'),
    (23, 1, "media", "AUTOPLAY_NO_CONTROLS",
     "Video autoplays with sound but has no controls. Users cannot pause or mute the video.",
     '<video src="v.mp4" autoplay=""><track kind="captions" src="c.vtt"/></video>'),
    (23, 2, "media", "AUTOPLAY_NO_CONTROLS",
     "Audio autoplays with sound but has no controls. Users cannot pause or mute the audio.",
     '<audio autoplay=""></audio>'),
    (24, 0, "language", "INVALID_LANG", None, None),
    (25, 0, "language", "MISSING_LANG",
     "HTML element is missing the 'lang' attribute. Screen readers use this to determine pronunciation.", None),
    (26, 0, "document_structure", "MISSING_TITLE",
     "Page is missing a <title> element. Titles help users identify pages in tabs and bookmarks.",
     "<head>...</head>"),
    (27, 1, "document_structure", "MISSING_H1",
     "Page is missing an <h1> element. The h1 should describe the main content of the page.", "<body>...</body>"),
]
# Where the missing-landmark issue of the plain page falls among the variant's issues.
MAIN_AT = {k: 0 for k in range(28) if k not in (20, 21)} | {
    1: 1, 2: 2, 3: 1, 4: 1, 6: 1, 7: 1, 8: 1, 9: 2, 10: 1, 11: 2, 12: 2, 13: 1, 24: 1, 25: 1, 26: 1,
}
ANALYZERS = (
    "alt_text form_labels heading_order contrast link_text language button document_structure table aria "
    "skip_link media"
).split()

_rows = EXPECTED + [
    (k, at, "document_structure", "MISSING_MAIN", MAIN, "<body>...</body>") for k, at in MAIN_AT.items()
]
VALUES = ",\n".join(f"({k}, {at}, {q(a)}, {q(c)}, {q(m)}, {q(x)})" for k, at, a, c, m, x in _rows)

SEVERITY = """
('IMG_MISSING_ALT','critical','1.1.1','Non-text Content','Screen reader users cannot understand image content'),
('LINK_IMG_MISSING_ALT','critical','1.1.1','Non-text Content','Screen reader users cannot understand link purpose'),
('FORM_CONTROL_NO_LABEL','critical','1.3.1','Info and Relationships','Screen reader users cannot identify form fields'),
('LINK_NO_TEXT','critical','2.4.4','Link Purpose (In Context)','Screen reader users cannot understand link destination'),
('BUTTON_NO_TEXT','critical','4.1.2','Name, Role, Value','Screen reader users cannot understand button purpose'),
('MISSING_LANG','critical','3.1.1','Language of Page','Screen readers may mispronounce content'),
('TABLE_NO_HEADERS','critical','1.3.1','Info and Relationships','Screen reader users cannot understand table structure'),
('ARIA_HIDDEN_FOCUSABLE','critical','4.1.2','Name, Role, Value','Keyboard users can focus invisible elements'),
('LOW_CONTRAST','major','1.4.3','Contrast (Minimum)','Users with low vision may not be able to read text'),
('VIDEO_NO_CAPTIONS','major','1.2.2','Captions (Prerecorded)','Deaf users cannot access video audio content'),
('AUDIO_NO_TRANSCRIPT','major','1.2.1','Audio-only and Video-only','Deaf users cannot access audio content'),
('INVALID_ARIA_ROLE','major','4.1.2','Name, Role, Value','Assistive technology may not interpret element correctly'),
('MISSING_MAIN','major','1.3.1','Info and Relationships','Screen reader users cannot easily navigate to main content'),
('AUTOPLAY_NO_CONTROLS','major','1.4.2','Audio Control','Users cannot stop unwanted audio'),
('HEADING_ORDER','minor','1.3.1','Info and Relationships','May confuse screen reader users navigating by headings'),
('INVALID_LANG','minor','3.1.1','Language of Page','Screen readers may not properly switch language'),
('NO_SKIP_LINK','minor','2.4.1','Bypass Blocks','Keyboard users must tab through all navigation'),
('BROKEN_SKIP_LINK','minor','2.4.1','Bypass Blocks','Skip link does not work as expected'),
('MULTIPLE_H1','minor','1.3.1','Info and Relationships','May confuse screen reader users about page structure'),
('TABLE_NO_CAPTION','minor','1.3.1','Info and Relationships','Screen reader users may not understand table purpose'),
('MISSING_TITLE','minor','2.4.2','Page Titled','Users may not identify page purpose in tabs/bookmarks')
"""

# expected: every issue of the injected pages, with page, position, site
WITH_EXPECTED = f"""
WITH spec(k, pos, analyzer, code, message, context) AS (VALUES
{VALUES}),
planted AS (
  SELECT page_id, url, CAST(page_id % 28 AS INTEGER) AS k, html,
         regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS site,
         regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
         replace(regexp_extract(html, '(<html .*)$', 1, 's'), '<meta charset="utf-8">', '<meta charset="utf-8"/>') AS tail
  FROM pages),
expected AS (
  SELECT page_id, url, site, k, pos, analyzer, code,
         coalesce(message, 'Invalid language code ''x' || lang || '''. Use a valid ISO 639-1 language code.') AS message,
         CASE code
           WHEN 'INVALID_LANG' THEN substring(replace(tail, '<html lang="', '<html lang="x'), 1, 100)
           WHEN 'MISSING_LANG' THEN substring(replace(tail, '<html lang=', '<html data-lang='), 1, 100)
           WHEN 'MULTIPLE_H1' THEN substring(regexp_extract(html, '<h1>.*?</h1>', 0, 's'), 1, 50) || ', <h1>Second</h1>'
           ELSE context END AS context
  FROM planted JOIN spec USING (k)),
severity(code, severity, wcag, wcag_name, impact) AS (VALUES {SEVERITY}),
enriched AS (
  SELECT e.*, coalesce(s.severity, 'minor') AS severity, s.wcag, s.wcag_name, s.impact
  FROM expected e LEFT JOIN severity s USING (code)),
page_counts AS (
  SELECT p.page_id, p.url, p.site, p.k, count(e.code) AS total,
         count(*) FILTER (WHERE e.severity = 'critical') AS critical,
         count(*) FILTER (WHERE e.severity = 'major') AS major,
         count(*) FILTER (WHERE e.severity = 'minor') AS minor
  FROM planted p LEFT JOIN enriched e USING (page_id) GROUP BY ALL)
"""

CODES = sorted({row[3] for row in _rows})
SITE = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"

SQL: dict[str, str] = {}

# -- plain pages ----------------------------------------------------------------------------

SQL["site_severity_summary"] = f"""
SELECT {SITE} AS site, count(*) AS pages, count(*) AS issues, 0 AS critical, count(*) AS major, 0 AS minor
FROM pages WHERE html NOT LIKE '%<main%' GROUP BY 1"""
SQL["page_elements_by_tag"] = """
SELECT page_id, tag, count(*) AS n
FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY ALL"""
SQL["page_links"] = """
SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, href,
       regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS dst_url
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
             unnest(range(1, 1 + len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) AS pos FROM pages)"""
SQL["page_titles"] = """
SELECT page_id, trim(replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '&amp;', '&')) AS title FROM pages"""
SQL["page_headings"] = """
SELECT page_id, array_to_string(regexp_extract_all(html, '<h([1-6])>', 1), ' ') AS levels FROM pages"""
SQL["elements_by_class"] = """
SELECT page_id, tag, class, count(*) AS n FROM (
  SELECT page_id, regexp_extract(t, '<([a-z]+)', 1) AS tag, regexp_extract(t, 'class="([^"]*)"', 1) AS class
  FROM (SELECT page_id, unnest(regexp_extract_all(html, '<[a-z]+ class="[^"]*"')) AS t FROM pages)) GROUP BY ALL"""

# -- injected pages: issues -------------------------------------------------------------------

SQL["injected_issues"] = WITH_EXPECTED + (
    "SELECT page_id, url, k, CAST(pos AS INTEGER) AS pos, analyzer, code, message, context FROM expected"
)
for code in CODES:
    SQL[f"rule_{code.lower()}"] = WITH_EXPECTED + (
        f"SELECT page_id, url, code, message, context FROM expected WHERE code = {q(code)}"
    )
SQL["issues_excluding"] = WITH_EXPECTED + (
    "SELECT page_id, analyzer, code, message, context FROM expected "
    "WHERE analyzer NOT IN ('document_structure', 'contrast', 'aria')"
)
SQL["legacy_rules"] = WITH_EXPECTED + """
SELECT page_id, code, CASE code WHEN 'HEADING_ORDER' THEN 'Heading level jumps (may confuse screen readers).'
                      ELSE message END AS message, context
FROM expected WHERE code IN ('IMG_MISSING_ALT', 'LINK_IMG_MISSING_ALT', 'FORM_CONTROL_NO_LABEL', 'LINK_NO_TEXT', 'HEADING_ORDER')
UNION ALL
SELECT page_id, 'LINK_NO_TEXT', 'Link has no accessible name (no text and no labelled content).', '<a href="/t" title="T"></a>'
FROM planted WHERE k = 9
UNION ALL
SELECT page_id, 'FORM_CONTROL_NO_LABEL', 'Form control is missing an accessible label.', '<textarea title="t"></textarea>'
FROM planted WHERE k = 5
UNION ALL
SELECT page_id, 'FORM_CONTROL_NO_LABEL', 'Form control is missing an accessible label.', '<input type="reset" value="R"/>'
FROM planted WHERE k = 12"""
SQL["table_contents"] = """
SELECT page_id, CAST(t.tr AS BIGINT) AS n_rows, CAST(t.th AS BIGINT) AS n_headers, CAST(t.td AS BIGINT) AS n_cells
FROM pages JOIN (VALUES (15, 2, 0, 2), (16, 2, 2, 2), (17, 2, 0, 2)) t(k, tr, th, td) ON page_id % 28 = t.k"""
SQL["custom_html_rule"] = """
SELECT page_id, 'no_tables' AS analyzer, 'HAS_TABLE' AS code, 'Page has a table.' AS message, 'k=' || (page_id % 28) AS context
FROM pages WHERE page_id % 28 IN (15, 16, 17)"""
# The rules and their descriptions.
RULES = """(VALUES
  ('alt_text', 'Detect missing alt text on images and linked images'),
  ('form_labels', 'Detect form controls without accessible labels'),
  ('heading_order', 'Detect heading level jumps that confuse screen readers'),
  ('contrast', 'Detect low contrast in inline style colors'),
  ('link_text', 'Detect links missing accessible text'),
  ('language', 'Detect missing or invalid lang attribute on HTML element'),
  ('button', 'Detect buttons without accessible names'),
  ('document_structure', 'Detect document structure issues (missing landmarks, multiple h1, etc.)'),
  ('table', 'Detect table accessibility issues (missing headers, captions)'),
  ('aria', 'Detect ARIA usage issues (invalid roles, aria-hidden on focusable)'),
  ('skip_link', 'Detect missing or broken skip navigation links'),
  ('media', 'Detect media accessibility issues (missing captions, transcripts)')) AS rules(name, description)"""
SQL["analyzers"] = f"""
SELECT name, description, coalesce(issues, 0) AS issues FROM {RULES} LEFT JOIN (
  SELECT analyzer, count(*) AS issues FROM (""" + WITH_EXPECTED + " SELECT analyzer FROM expected) GROUP BY 1) ON analyzer = name"
SQL["idle_analyzers"] = f"""
SELECT name, description, CASE WHEN name = 'document_structure' THEN n ELSE 0 END AS issues
FROM {RULES}, (SELECT count(*) AS n FROM pages WHERE html NOT LIKE '%<main%')"""

# -- injected pages: counts and reports ---------------------------------------------------------

SQL["enriched_issues"] = WITH_EXPECTED + (
    "SELECT page_id, url, code, message, context, severity, wcag, wcag_name, impact FROM enriched"
)
RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 ELSE 2 END"
SQL["issues_sorted"] = WITH_EXPECTED + f"""
SELECT page_id, code, severity, CAST({RANK} AS INTEGER) AS severity_rank,
       CAST(row_number() OVER (PARTITION BY page_id ORDER BY {RANK}, pos) - 1 AS INTEGER) AS place FROM enriched"""
SQL["issues_by_code"] = WITH_EXPECTED + "SELECT code, count(*) AS n FROM expected GROUP BY 1"
SQL["issues_by_severity"] = WITH_EXPECTED + """
SELECT site, count(*) FILTER (WHERE severity = 'critical') AS critical,
       count(*) FILTER (WHERE severity = 'major') AS major, count(*) FILTER (WHERE severity = 'minor') AS minor
FROM enriched GROUP BY 1"""
SQL["severity_styles"] = WITH_EXPECTED + """
SELECT severity, CASE severity WHEN 'critical' THEN 'red' WHEN 'major' THEN 'yellow' WHEN 'minor' THEN 'blue' END AS color,
       CASE severity WHEN 'critical' THEN '🔴' WHEN 'major' THEN '🟡' WHEN 'minor' THEN '🔵' END AS emoji, count(*) AS n
FROM enriched GROUP BY 1"""
SQL["page_site_totals"] = WITH_EXPECTED + """
SELECT CASE WHEN grouping(url) = 0 THEN 'page' WHEN grouping(site) = 0 THEN 'site' ELSE 'all' END AS level, site, url,
       CAST(sum(total) AS BIGINT) AS issues, CAST(sum(critical) AS BIGINT) AS critical,
       CAST(sum(major) AS BIGINT) AS major, CAST(sum(minor) AS BIGINT) AS minor
FROM page_counts GROUP BY GROUPING SETS ((site, url), (site), ())"""
SQL["injected_site_summary"] = WITH_EXPECTED + """
SELECT site, count(*) AS pages, CAST(sum(total) AS BIGINT) AS issues, CAST(sum(critical) AS BIGINT) AS critical,
       CAST(sum(major) AS BIGINT) AS major, CAST(sum(minor) AS BIGINT) AS minor FROM page_counts GROUP BY 1"""
SQL["issue_count_per_page"] = WITH_EXPECTED + "SELECT page_id, url, total, critical, major, minor FROM page_counts"

# -- reports ------------------------------------------------------------------------------------


def esc(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


ANCHOR = "substring(regexp_replace(url, '[^a-zA-Z0-9]', '-', 'g'), 1, 50)"
STATUS = "CASE WHEN total = 0 THEN 'success' WHEN critical = 0 THEN 'warning' ELSE 'danger' END"
EMOJI = "CASE severity WHEN 'critical' THEN '🔴' WHEN 'major' THEN '🟡' ELSE '🔵' END"
PLACE = f"CAST(row_number() OVER (PARTITION BY page_id ORDER BY {RANK}, pos) - 1 AS INTEGER)"
CHART = "'{\"critical\": ' || critical || ', \"major\": ' || major || ', \"minor\": ' || minor || '}'"

SQL["page_overview"] = WITH_EXPECTED + (
    f"SELECT site, page_id, url, {ANCHOR} AS anchor, total, critical, major, minor, {STATUS} AS status_class FROM page_counts"
)
SQL["issue_details"] = WITH_EXPECTED + f"""
SELECT site, page_id, url, {ANCHOR} AS anchor, {PLACE} AS place, severity AS severity_class,
       {EMOJI} || ' ' || upper(severity) AS badge, code, coalesce(wcag, '-') AS wcag, {esc('message')} AS message,
       {esc('substring(context, 1, 100)')} || CASE WHEN length(context) > 100 THEN '...' ELSE '' END AS context
FROM enriched"""
SQL["site_header"] = SQL["injected_site_summary"].replace(
    "SELECT site, count(*) AS pages", "SELECT *, " + CHART + """ AS chart_data FROM (SELECT site,
  'Sites &amp; pages' AS title, '2024-01-01 00:00:00' AS generated, '1' AS version, count(*) AS total_pages"""
).replace("AS issues", "AS total_issues") + ")"
SQL["page_header"] = WITH_EXPECTED + f"""
SELECT page_id, url, 'Accessibility Report' AS title, '2024-01-01 00:00:00' AS generated, '1' AS version,
       total AS total_issues, critical, major, minor, {CHART} AS chart_data FROM page_counts"""
SQL["console_pages"] = WITH_EXPECTED + """
SELECT page_id, '  ' || CASE WHEN total = 0 THEN '✅' ELSE '⚠️' END || ' ' || url || ': ' || total || ' issues' AS line
FROM page_counts"""
SQL["top_issues"] = WITH_EXPECTED + f"""
SELECT page_id, place, emoji, code, wcag, message, context FROM (
  SELECT page_id, {PLACE} AS place, {RANK} AS r, {EMOJI} AS emoji, code, coalesce(wcag, '') AS wcag, message,
         substring(context, 1, 40) || '...' AS context FROM enriched)
ORDER BY r, page_id, place LIMIT 50"""
SQL["issues_beyond"] = WITH_EXPECTED + """
SELECT count(*) AS pages, CAST(sum(total) AS BIGINT) AS issues, CAST(sum(critical) AS BIGINT) AS critical,
       CAST(sum(major) AS BIGINT) AS major, CAST(sum(minor) AS BIGINT) AS minor,
       CAST(greatest(sum(total) - 50, 0) AS BIGINT) AS more FROM page_counts"""
SQL["nested_report"] = WITH_EXPECTED + """
, lists AS (
  SELECT page_id, list({'code': code, 'message': message, 'context': context, 'analyzer': analyzer,
                        'severity': severity, 'wcag': wcag, 'wcag_name': wcag_name, 'impact': impact} ORDER BY pos) AS issues
  FROM enriched GROUP BY 1),
codes AS (
  SELECT page_id, string_agg(code || '=' || n, ',' ORDER BY code) AS summary
  FROM (SELECT page_id, code, count(*) AS n FROM expected GROUP BY ALL) GROUP BY 1)
SELECT p.page_id, p.url,
       '{"issues":' || coalesce(to_json(l.issues), '[]') || ',"severity_summary":{"critical":' || critical || ',"major":'
       || major || ',"minor":' || minor || '},"version":"1"}' AS report, coalesce(c.summary, '') AS summary
FROM page_counts p LEFT JOIN lists l USING (page_id) LEFT JOIN codes c USING (page_id)"""
SQL["site_documents"] = WITH_EXPECTED + """
, lists AS (
  SELECT page_id, list({'code': code, 'message': message, 'context': context, 'analyzer': analyzer,
                        'severity': severity, 'wcag': wcag, 'wcag_name': wcag_name, 'impact': impact} ORDER BY pos) AS issues
  FROM enriched GROUP BY 1),
codes AS (
  SELECT page_id, string_agg('"' || code || '":' || n, ',' ORDER BY first) AS summary
  FROM (SELECT page_id, code, count(*) AS n, min(pos) AS first FROM expected GROUP BY ALL) GROUP BY 1),
lines AS (
  SELECT site, 0 AS part, 0 AS page_id, '{"pages":{' AS line FROM planted GROUP BY site
  UNION ALL
  SELECT p.site, 1, p.page_id, CASE WHEN row_number() OVER (PARTITION BY p.site ORDER BY p.page_id) > 1 THEN ',' ELSE '' END || '"' || p.url
    || '":{"issues":' || coalesce(to_json(l.issues), '[]') || ',"summary":{' || coalesce(c.summary, '') || '},"severity_summary":{"critical":'
    || critical || ',"major":' || major || ',"minor":' || minor || '}}'
  FROM page_counts p LEFT JOIN lists l USING (page_id) LEFT JOIN codes c USING (page_id)
  UNION ALL
  SELECT site, 2, 0, '},"version":"1","severity_summary":{"critical":' || sum(critical)::BIGINT || ',"major":' || sum(major)::BIGINT || ',"minor":'
    || sum(minor)::BIGINT || '}}' FROM page_counts GROUP BY site)
SELECT site, row_number() OVER (PARTITION BY site ORDER BY part, page_id) - 1 AS n, line FROM lines"""
SQL["report_text"] = WITH_EXPECTED + f"""
, details AS (
  SELECT site, page_id, {PLACE} AS place, severity AS severity_class, {EMOJI} || ' ' || upper(severity) AS badge, code, coalesce(wcag, '-') AS wcag,
         {esc('message')} AS message,
         {esc('substring(context, 1, 100)')} || CASE WHEN length(context) > 100 THEN '...' ELSE '' END AS context
  FROM enriched),
pages_shown AS (SELECT *, {ANCHOR} AS anchor, {STATUS} AS status_class, {esc('url')} AS shown FROM page_counts),
totals AS (
  SELECT site, count(*) AS pages, sum(total)::BIGINT AS issues, sum(critical)::BIGINT AS critical, sum(major)::BIGINT AS major,
         sum(minor)::BIGINT AS minor FROM page_counts GROUP BY site),
lines AS (
  SELECT site, 0 AS part, 0 AS weight, 0 AS page_id, 0 AS place, '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>'
    || 'Accessibility Report</title></head><body><main><h1>Accessibility Report</h1><p>2024-01-01 00:00:00 / 1</p><p>' || pages || ' pages, '
    || issues || ' issues: ' || critical || ' critical, ' || major || ' major, ' || minor || ' minor</p>'
    || '<script type="application/json" id="chart">' || {CHART} || '</script><table>' AS line FROM totals
  UNION ALL
  SELECT site, 1, -total, page_id, 0, '<tr class="' || status_class || '"><td><a href="#' || anchor || '">' || shown || '</a></td><td>' || total
    || '</td><td>' || critical || '</td><td>' || major || '</td><td>' || minor || '</td></tr>' FROM pages_shown
  UNION ALL SELECT site, 1, 1, 0, 0, '</table>' FROM totals
  UNION ALL
  SELECT site, 2, 0, page_id, 0, '<section id="' || anchor || '"><h2><a href="' || shown || '">' || shown || '</a> ' || total
    || ' issues</h2><table>' FROM pages_shown WHERE total > 0
  UNION ALL
  SELECT site, 2, 0, page_id, place + 1, '<tr class="severity-' || severity_class || '"><td>' || badge || '</td><td><code>' || code
    || '</code></td><td>' || wcag || '</td><td>' || message || '</td><td><code>' || context || '</code></td></tr>' FROM details
  UNION ALL SELECT site, 2, 0, page_id, total + 1, '</table></section>' FROM pages_shown WHERE total > 0
  UNION ALL SELECT site, 3, 0, 0, 0, '</main></body></html>' FROM totals)
SELECT site, row_number() OVER (PARTITION BY site ORDER BY part, weight, page_id, place) - 1 AS n, line FROM lines"""
SQL["report_lines"] = WITH_EXPECTED + """
SELECT site, 0 AS part, CAST(1 AS BIGINT) AS n_lines FROM planted GROUP BY site
UNION ALL SELECT site, 3, 1 FROM planted GROUP BY site
UNION ALL SELECT site, 1, count(*) + 1 FROM planted GROUP BY site
UNION ALL SELECT site, 2, CAST(sum(total + 2) AS BIGINT) FROM page_counts WHERE total > 0 GROUP BY site"""

# -- colours ------------------------------------------------------------------------------------


def hx(x: str) -> str:
    return f"printf('%02x', CAST({x} AS INTEGER))"


RGB = f"'#' || {hx('l_orderkey % 256')} || {hx('l_partkey % 256')} || {hx('l_suppkey % 256')}"
BG = f"'#' || {hx('l_partkey * 31 % 256')} || {hx('l_suppkey * 17 % 256')} || {hx('l_orderkey * 7 % 256')}"
H1 = "printf('%x', CAST({0} % 16 AS INTEGER))"
COLOR_VALUE = f"""CASE l_linenumber
  WHEN 1 THEN '#' || upper(substring({RGB}, 2))
  WHEN 2 THEN ' #' || upper({H1.format('l_orderkey')}) || upper({H1.format('l_partkey')}) || {H1.format('l_suppkey')}
  WHEN 3 THEN 'rgb(' || l_orderkey % 256 || ', ' || l_partkey % 256 || ',' || l_suppkey % 256 || ')'
  WHEN 4 THEN 'RGBA(' || l_orderkey % 101 || '%,' || l_partkey % 256 || ' ,' || l_suppkey % 256 || ',.5)'
  WHEN 5 THEN 'hsl(' || l_orderkey % 360 || ', ' || l_partkey % 101 || '%, ' || l_suppkey % 101 || '%)'
  WHEN 6 THEN (['white', 'Black', 'navy ', 'orange'])[l_orderkey % 4 + 1]
  ELSE 'var(--c' || l_partkey || ')' END"""
DOUBLED = " || ".join(f"{H1.format(c)} || {H1.format(c)}" for c in ("l_orderkey", "l_partkey", "l_suppkey"))


def hue(shift: str) -> str:
    return f"""(SELECT CASE WHEN s = 0 THEN l WHEN t < CAST(1 AS DOUBLE) / 6 THEN p + (qq - p) * 6 * t
  WHEN t < CAST(1 AS DOUBLE) / 2 THEN qq WHEN t < CAST(2 AS DOUBLE) / 3
  THEN p + (qq - p) * (CAST(2 AS DOUBLE) / 3 - t) * 6 ELSE p END
  FROM (SELECT CASE WHEN h + {shift} < 0 THEN h + {shift} + 1 WHEN h + {shift} > 1 THEN h + {shift} - 1 ELSE h + {shift} END AS t))"""


SQL["parsed_colors"] = f"""
WITH hsl AS (SELECT *, 2 * l - qq AS p FROM (
  SELECT *, CASE WHEN l < 0.5 THEN l * (1 + s) ELSE l + s - l * s END AS qq FROM (
    SELECT *, CAST(l_orderkey % 360 AS DOUBLE) / 360 AS h, CAST(l_partkey % 101 AS DOUBLE) / 100 AS s,
           CAST(l_suppkey % 101 AS DOUBLE) / 100 AS l FROM lineitem)))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {COLOR_VALUE} AS value, CASE l_linenumber
  WHEN 1 THEN {RGB} WHEN 2 THEN '#' || {DOUBLED} WHEN 3 THEN {RGB}
  WHEN 4 THEN '#' || {hx('l_orderkey % 101')} || substring({RGB}, 4)
  WHEN 5 THEN '#' || {hx(f"trunc({hue('CAST(1 AS DOUBLE) / 3')} * 255)")} || {hx(f"trunc({hue('0')} * 255)")}
                  || {hx(f"trunc({hue('-CAST(1 AS DOUBLE) / 3')} * 255)")}
  WHEN 6 THEN (['#ffffff', '#000000', '#000080', '#ffa500'])[l_orderkey % 4 + 1] END AS color
FROM hsl"""
SQL["parsed_fix_colors"] = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {COLOR_VALUE} AS value,
       CASE l_linenumber WHEN 1 THEN {RGB} WHEN 2 THEN '#' || {DOUBLED} WHEN 3 THEN {RGB} END AS color
FROM lineitem"""


def lum(r: str, g: str, b: str) -> str:
    def lin(c: str) -> str:
        s = f"(CAST({c} AS DOUBLE) / 255)"
        return f"CASE WHEN {s} <= 0.03928 THEN {s} / 12.92 ELSE pow(({s} + 0.055) / 1.055, 2.4) END"

    return f"0.2126 * ({lin(r)}) + 0.7152 * ({lin(g)}) + 0.0722 * ({lin(b)})"


SQL["contrast_ratios"] = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, fg, bg,
       round((greatest(a, b) + 0.05) / (least(a, b) + 0.05), 6) AS ratio, round(a, 6) AS luminance,
       CASE WHEN (b + 0.05) / 0.05 >= 4.5 THEN '#000000' ELSE '#ffffff' END AS recommended
FROM (SELECT *, {RGB} AS fg, {BG} AS bg,
             {lum('l_orderkey % 256', 'l_partkey % 256', 'l_suppkey % 256')} AS a,
             {lum('l_partkey * 31 % 256', 'l_suppkey * 17 % 256', 'l_orderkey * 7 % 256')} AS b FROM lineitem)"""

# -- links, robots, crawls ------------------------------------------------------------------------

GRAPH = """
WITH RECURSIVE nodes AS (
  SELECT page_id AS i, (SELECT count(*) FROM pages) AS n, 's' || (page_id % 5) || '.test' AS site FROM pages),
targets AS (
  SELECT i, site, k, CASE WHEN k < 3 THEN (i + 5 * (3 * k + 1) * (i // 5 % 7 + 1)) % n ELSE (i + 1) % n END AS j
  FROM nodes, range(4) r(k)),
node_url AS (
  SELECT i, site, 'http://' || site || CASE WHEN i % 15 = 10 THEN '/private/' ELSE '/p/' END || i AS url FROM nodes),
links AS (
  SELECT t.i, t.site, t.k AS pos, u.site AS dst_site, u.url AS dst,
         CASE t.k WHEN 0 THEN substring(u.url, 15) WHEN 1 THEN '..' || substring(u.url, 15)
                  WHEN 2 THEN u.url || '#sec' ELSE u.url END AS href
  FROM targets t JOIN node_url u ON u.i = t.j
  UNION ALL SELECT i, site, 4, site, 'http://' || site || '/missing/' || i, '/missing/' || i FROM nodes)"""
SQL["resolved_links"] = GRAPH + """
SELECT i AS page_id, CAST(pos AS INTEGER) AS pos, href, dst AS dst_url, site = dst_site AS same_site FROM links
UNION ALL SELECT i, 5, 'mailto:x@y.test', 'mailto:x@y.test', false FROM nodes"""

VISITS = GRAPH + """,
start AS (
  SELECT site, url, [0] AS path FROM node_url WHERE i >= 10 AND i < 15
  UNION ALL SELECT site, url, [CAST(1 + i // 5 AS INTEGER)] FROM node_url WHERE i < 10),
walk AS (
  SELECT 0 AS level, site, url, min(path) AS path FROM start GROUP BY ALL
  UNION ALL
  SELECT w.level + 1, w.site, l.dst, min(list_append(w.path, CAST(l.pos AS INTEGER)))
  FROM walk w JOIN node_url u ON u.url = w.url AND u.i % 15 <> 10
       JOIN links l ON l.i = u.i AND l.dst_site = l.site
  WHERE w.level < 60 GROUP BY w.level + 1, w.site, l.dst),
visits AS (
  SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY level, path) AS rank, CAST(level AS INTEGER) AS level,
         CASE WHEN url LIKE '%/private/%' THEN 'blocked' WHEN url LIKE '%/missing/%' THEN 'failed' ELSE 'ok' END AS outcome
  FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY level, path) AS first FROM walk) WHERE first = 1
  QUALIFY rank <= 40)
"""
SQL["crawl_site"] = VISITS + "SELECT * FROM visits"
SQL["crawl_all"] = VISITS.replace("QUALIFY rank <= 40", "") + "SELECT * FROM visits"
SQL["crawl_progress"] = VISITS + """
SELECT site, level, visited, CAST(sum(visited) OVER (PARTITION BY site ORDER BY level) AS BIGINT) AS scanned
FROM (SELECT site, level, count(*) AS visited FROM visits GROUP BY ALL)"""
SQL["scan_site"] = VISITS + """
SELECT v.site, v.url, rank, outcome, CAST(coalesce(n, 0) AS INTEGER) AS total, CAST(coalesce(n, 0) AS INTEGER) AS critical,
       0 AS major, 0 AS minor
FROM visits v LEFT JOIN (SELECT url, 1 AS n FROM node_url WHERE i % 3 = 0) x ON x.url = v.url AND outcome = 'ok'"""
SQL["crawl_page_progress"] = VISITS + """,
finds AS (
  SELECT v.site, l.dst, min(v.rank) AS rank FROM visits v JOIN node_url u ON u.url = v.url JOIN links l ON l.i = u.i AND l.dst_site = l.site
  WHERE outcome = 'ok' GROUP BY ALL),
fresh AS (SELECT site, rank, count(*) AS n FROM finds WHERE dst NOT IN (SELECT url FROM start) GROUP BY ALL)
SELECT v.site, url, v.rank, v.rank AS scanned, CAST(3 + coalesce(sum(n) OVER (
  PARTITION BY v.site ORDER BY v.rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS found
FROM visits v LEFT JOIN fresh ON fresh.site = v.site AND fresh.rank = v.rank WHERE outcome = 'ok'"""
REQUEST_VISITS = GRAPH + """,
requests AS (SELECT i AS request, site, url, CASE WHEN i < 15 THEN 40 ELSE 25 END AS cap FROM node_url WHERE i >= 10 AND i < 20),
start AS (
  SELECT request, site, url, [0] AS path FROM requests
  UNION ALL SELECT request, r.site, u.url, [CAST(1 + i // 5 AS INTEGER)] FROM requests r JOIN node_url u ON u.site = r.site AND i < 10),
walk AS (
  SELECT 0 AS level, request, site, url, min(path) AS path FROM start GROUP BY ALL
  UNION ALL
  SELECT w.level + 1, w.request, w.site, l.dst, min(list_append(w.path, CAST(l.pos AS INTEGER)))
  FROM walk w JOIN node_url u ON u.url = w.url AND u.i % 15 <> 10 JOIN links l ON l.i = u.i AND l.dst_site = l.site
  WHERE w.level < 60 GROUP BY w.level + 1, w.request, w.site, l.dst),
visits AS (
  SELECT request, site, url, row_number() OVER (PARTITION BY request ORDER BY level, path) AS rank, CAST(level AS INTEGER) AS level,
         CASE WHEN url LIKE '%/private/%' THEN 'blocked' WHEN url LIKE '%/missing/%' THEN 'failed' ELSE 'ok' END AS outcome, cap
  FROM (SELECT *, row_number() OVER (PARTITION BY request, url ORDER BY level, path) AS first FROM walk) JOIN (
    SELECT request, cap FROM requests) USING (request) WHERE first = 1 QUALIFY rank <= cap),
scanned AS (
  SELECT v.*, outcome = 'ok' AND u.i % 3 = 0 AND request < 15 AS missing_alt FROM visits v LEFT JOIN node_url u ON u.url = v.url)
"""
SQL["scan_site_requests"] = REQUEST_VISITS + "SELECT request, site, url, rank, level, outcome, CAST(missing_alt AS INTEGER) AS total FROM scanned"
SQL["site_scan_history"] = REQUEST_VISITS + """
SELECT site, url, CASE WHEN arg_min(missing_alt, request) THEN 'IMG_MISSING_ALT' ELSE '' END AS codes, CAST(1700000000 AS BIGINT) AS ts
FROM scanned WHERE outcome = 'ok' GROUP BY site, url"""
SQL["crawl_basic"] = GRAPH + """,
walk AS (
  SELECT 0 AS level, site, url, [0] AS path FROM node_url WHERE i >= 10 AND i < 15
  UNION ALL
  SELECT w.level + 1, w.site, l.dst || CASE WHEN l.pos = 2 THEN '#sec' ELSE '' END,
         min(list_append(w.path, CAST(l.pos AS INTEGER)))
  FROM walk w JOIN node_url u ON u.url = split_part(w.url, '#', 1)
       JOIN links l ON l.i = u.i AND l.dst_site = l.site
  WHERE w.level < 60 GROUP BY 1, 2, 3)
SELECT site, url, rank, 'ok' AS outcome FROM (
  SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY level, path) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY level, path) AS first FROM walk) WHERE first = 1)
WHERE rank <= 20 AND url NOT LIKE '%/missing/%'"""

# robots text kind, group, agents, disallow, delay
GROUPS = """(VALUES (0, 1, '*', '/a|/b # note', 2.5), (1, 1, 'sightline-scanner', '/own', NULL), (1, 2, '*', '/all', NULL),
  (2, 1, 'SIGHTLINE', '', NULL), (2, 2, 'bingbot', '/stacked', NULL), (2, 3, '*', '/star', NULL), (3, 0, '', '/orphan', NULL),
  (3, 1, 'other', '/x', NULL), (4, 1, '*', '', 1.0), (6, 1, '*', '/c', 0.0)) g(k, group_no, agents, disallow, crawl_delay)"""
CHOSEN = """(VALUES (0, '/a|/b # note', 2.5), (1, '/own', 0.0), (2, '', 0.0), (4, '', 1.0), (6, '/c', 0.0)) g(k, disallow, crawl_delay)"""
SQL["robots_rules"] = f"""
SELECT 'c' || c_custkey || '.test' AS site, CAST(group_no AS INTEGER) AS group_no, agents, disallow,
       CAST(crawl_delay AS DOUBLE) AS crawl_delay FROM customer JOIN {GROUPS} ON c_custkey % 7 = k"""
SQL["robots_choice"] = f"""
SELECT 'c' || c_custkey || '.test' AS site, disallow, CAST(crawl_delay AS DOUBLE) AS crawl_delay
FROM customer JOIN {CHOSEN} ON c_custkey % 7 = k"""
SQL["crawl_delay"] = f"""
SELECT 'c' || c_custkey || '.test' AS site, CAST(greatest(coalesce(crawl_delay, 0), 1) AS DOUBLE) AS delay
FROM customer LEFT JOIN {CHOSEN} ON c_custkey % 7 = k"""
SQL["blocked_urls"] = """
SELECT o_orderkey, url, CASE (o_custkey % 7) WHEN 0 THEN path LIKE '/a%' OR path LIKE '/b # note%' WHEN 1 THEN path LIKE '/own%'
         WHEN 6 THEN path LIKE '/c%' ELSE false END AND o_custkey IN (SELECT c_custkey FROM customer) AS blocked
FROM (SELECT *, 'http://c' || o_custkey || '.test' || raw AS url,
             CASE WHEN raw = '' THEN '/' ELSE regexp_extract(raw, '^[^?#]*') END AS path
      FROM (SELECT *, (['/a/1', '/all?x=/c', '', '/own', '/b # note', '/c/d', '/star'])[o_orderkey % 7 + 1] AS raw FROM orders))"""
SQL["valid_urls"] = """
SELECT o_orderkey, (['http://c', 'HTTPS://c', 'ftp://c', 'c', 'http:///'])[o_orderkey % 5 + 1] || o_custkey || '.test/x' AS url,
       o_orderkey % 5 < 2 AS valid FROM orders"""
SQL["sitemap_urls"] = """
SELECT 'c' || c_custkey || '.test' AS site, 0 AS pos, 'http://c' || c_custkey || '.test/a?x=1&y=' || c_nationkey AS loc FROM customer
UNION ALL SELECT 'c' || c_custkey || '.test', 1, 'http://c' || c_custkey || '.test/b' FROM customer"""

# -- history and runs -------------------------------------------------------------------------------

HISTORY = """
, codes AS (SELECT page_id, string_agg(code, ',' ORDER BY pos) AS codes FROM expected GROUP BY 1)
SELECT site, url, coalesce(codes, '') AS codes, CAST(base + length(url) AS BIGINT) AS ts
FROM planted LEFT JOIN codes USING (page_id), (VALUES (1700000000), (1700100000)) b(base)"""
SQL["scan_history"] = WITH_EXPECTED + HISTORY
SQL["site_history"] = WITH_EXPECTED + HISTORY + " WHERE site = (SELECT site FROM planted ORDER BY page_id LIMIT 1)"
RUNS = """
WITH runs AS (
  SELECT 'scan-' || o_orderkey AS scan_id, *, TIMESTAMP '2023-11-14 22:13:20' + o_orderkey * INTERVAL 1 MINUTE AS t FROM orders
  WHERE o_orderkey % 11 <> 0),
state AS (
  SELECT scan_id, CASE WHEN o_orderkey % 7 = 0 THEN 'pending' WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'completed' END AS status,
         'http://c' || o_custkey || '.test/' AS url,
         CAST(CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN 0 ELSE o_custkey % 50 END AS INTEGER) AS pages_scanned,
         CAST(CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 1000 END AS INTEGER) AS total_issues,
         CASE WHEN o_orderkey % 7 <> 0 THEN t + INTERVAL 1 MINUTE END AS started_at,
         CASE WHEN o_orderkey % 7 <> 0 THEN t + INTERVAL 9 MINUTE END AS completed_at,
         CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0 THEN 'timeout ' || o_orderkey END AS error
  FROM runs)
"""
SQL["scan_runs"] = RUNS + "SELECT * FROM state"
SQL["recent_runs"] = RUNS + "SELECT * FROM state ORDER BY started_at DESC NULLS LAST, scan_id LIMIT 10"
SQL["run_after_delete"] = RUNS + (
    "SELECT status, count(*) AS n FROM state WHERE scan_id <> (SELECT min(scan_id) FROM state) GROUP BY 1"
)

# -- fixes --------------------------------------------------------------------------------------------

FIXES = """
WITH fixes(k, pos, code, fix, context) AS (VALUES
  (1, 0, 'IMG_MISSING_ALT', 'set alt=''logo.png''', '<img src="logo.png" alt="logo.png"/>'),
  (2, 0, 'IMG_MISSING_ALT', 'set alt=''Icon''', '<img src="i.png" alt="Icon"/>'),
  (3, 0, 'IMG_MISSING_ALT', 'set alt=''b.png''', '<img src="b.png" alt="b.png"/>'),
  (7, 0, 'LOW_CONTRAST', 'set color=#000000', '<p style="color: #000000;  background-color: #ffffff">t</p>'))
"""
SQL["applied_fixes"] = FIXES + (
    "SELECT page_id, CAST(pos AS INTEGER) AS pos, code, fix, context FROM pages JOIN fixes ON page_id % 28 = k"
)
SQL["fix_summary"] = FIXES + "SELECT code, count(*) AS n FROM pages JOIN fixes ON page_id % 28 = k GROUP BY 1"
SQL["fix_report"] = FIXES + """
SELECT page_id, CASE WHEN k IS NULL THEN 0 ELSE 1 END AS n, coalesce('   - ' || code || ': ' || fix, '') AS lines,
       CAST(NULL AS VARCHAR) AS fix_error FROM pages LEFT JOIN fixes ON page_id % 28 = k"""
SQL["alt_fixes_from_parts"] = """
SELECT page_id, 'IMG_MISSING_ALT' AS code, 'set alt=''' || alt || '''' AS fix,
       substring('<img src="' || src || '" id="pic" alt="' || alt || '"/>', 1, 200) AS context
FROM (SELECT page_id, 'img' || (page_id + 1) || '.png' AS src, coalesce(p_name, 'img' || (page_id + 1) || '.png') AS alt
      FROM pages LEFT JOIN part ON p_partkey = page_id + 1)"""
SQL["refixed_pages"] = WITH_EXPECTED + """
SELECT code, count(*) AS n FROM expected
WHERE code NOT IN ('IMG_MISSING_ALT', 'LINK_IMG_MISSING_ALT') AND NOT (code = 'LOW_CONTRAST' AND k = 7) GROUP BY 1"""
SQL["suggestion_prompts"] = WITH_EXPECTED + """
, edited AS (SELECT page_id, url, k, CASE k """ + " ".join(
    f"WHEN {k} THEN replace(html, {q(a)}, {q(b)})"
    for k, (a, b) in ({k: ("<footer>", x + "<footer>") for k, x in SNIPPETS.items()} | EDITS).items()
) + """ ELSE html END AS html FROM planted),
lists AS (
  SELECT page_id, to_json(list({'code': code, 'message': message, 'context': context, 'analyzer': analyzer} ORDER BY pos)) AS issues
  FROM expected GROUP BY 1)
SELECT page_id, url, 'You are an accessibility expert. Given the site HTML and list of issues, '
       || 'provide concise, actionable fixes for each issue.' || chr(10) || chr(10) || 'Found issues: '
       || coalesce(issues, '[]') || chr(10) || chr(10) || 'HTML snippet (truncated):' || chr(10) || substring(html, 1, 4000) AS prompt
FROM edited LEFT JOIN lists USING (page_id)"""

# -- request logs ---------------------------------------------------------------------------------------

LOG = """
WITH RECURSIVE log AS (
  SELECT *, row_number() OVER (PARTITION BY host ORDER BY t, id) AS n FROM (
    SELECT user_id AS host, event_id AS id, CAST((epoch_us(ts) - 1704067200000000) // 97656250 AS DOUBLE) / 1024 AS t,
           value / 20 AS response_time, event_type = 'error' AS is_error FROM events))
"""
SQL["rate_grants"] = LOG + """,
g AS (
  SELECT host, id, n, t, t AS granted FROM log WHERE n = 1
  UNION ALL
  SELECT l.host, l.id, l.n, l.t, greatest(l.t, g.granted + 0.5) FROM g JOIN log l ON l.host = g.host AND l.n = g.n + 1)
SELECT host, id, round(granted, 6) AS granted, round(granted - t, 6) AS waited FROM g"""
SQL["adaptive_rates"] = LOG + """,
counted AS (SELECT *, count(*) FILTER (WHERE NOT is_error) OVER (PARTITION BY host ORDER BY n) AS successes FROM log),
r AS (
  SELECT host, CAST(0 AS BIGINT) AS n, CAST(2 AS DOUBLE) AS rate FROM log GROUP BY 1
  UNION ALL
  SELECT c.host, c.n, CASE WHEN is_error OR response_time > 5 THEN greatest(rate * 0.8, 0.1)
                           WHEN successes % 10 = 0 THEN least(rate * 1.1, 10) ELSE rate END
  FROM r JOIN counted c ON c.host = r.host AND c.n = r.n + 1)
SELECT r.host, round(rate, 6) AS current_rate, success_count, error_count, slow_response_count
FROM r JOIN (SELECT host, max(n) AS n, count(*) FILTER (WHERE NOT is_error) AS success_count,
                    count(*) FILTER (WHERE is_error) AS error_count,
                    count(*) FILTER (WHERE NOT is_error AND response_time > 5) AS slow_response_count
             FROM log GROUP BY 1) s ON s.host = r.host AND s.n = r.n"""
SQL["busy_adaptive_rates"] = SQL["adaptive_rates"].replace("user_id AS host", "user_id % 3 AS host")
SQL["request_stats"] = """
SELECT user_id AS host, count(*) FILTER (WHERE event_type <> 'error') AS success_count,
       count(*) FILTER (WHERE event_type = 'error') AS error_count,
       count(*) FILTER (WHERE event_type <> 'error' AND value / 20 > 5) AS slow_response_count
FROM events GROUP BY 1"""
SQL["fetch_results"] = """
SELECT event_id, url, attempt, status, error,
       CASE WHEN error = 'tls' THEN 'failed' WHEN error IS NOT NULL THEN CASE WHEN attempt < 3 THEN 'retry' ELSE 'failed' END
            WHEN status IN (200, 204) THEN 'ok' WHEN status IN (404, 418) THEN 'empty' ELSE 'failed' END AS outcome
FROM (SELECT event_id, 'http://u' || user_id || '.test/' AS url, CAST(event_id % 3 + 1 AS INTEGER) AS attempt,
             ([200, 204, 301, 404, 429, 500, 503, 418])[user_id % 8 + 1] AS status,
             CASE WHEN event_type = 'error' THEN (['timeout', 'connect', 'read', 'tls'])[event_id % 4 + 1] END AS error FROM events)"""

# -- streams: the same answers as in batch ------------------------------------------------------------------

SQL["stream_scan"] = WITH_EXPECTED + HISTORY.replace("CAST(base + length(url) AS BIGINT)", "CAST(base AS BIGINT)").replace(
    "(1700000000), (1700100000)", "(1700000000)"
)
SQL["stream_seen_urls"] = "SELECT DISTINCT url FROM pages"
SQL["stream_severity_counts"] = SQL["injected_site_summary"]
SQL["stream_rate_grants"] = SQL["rate_grants"]
SQL["stream_adaptive_rates"] = SQL["adaptive_rates"]
SQL["stream_busy_rates"] = SQL["busy_adaptive_rates"]

# -- scan requests --------------------------------------------------------------------------------------------

SQL["accepted_requests"] = """
SELECT url, true AS valid, 36 AS id_length FROM pages
UNION ALL SELECT 'ftp://nowhere.test/' || page_id, false, 36 FROM pages
UNION ALL SELECT 'http://nowhere.test/' || page_id, true, 36 FROM pages"""
SQL["request_results"] = WITH_EXPECTED + """
SELECT p.url, 'completed' AS status, 1 AS pages_scanned, CAST(last.total AS INTEGER) AS total_issues, CAST(NULL AS VARCHAR) AS error
FROM page_counts p JOIN (SELECT split_part(url, '#', 1) AS address, arg_max(total, page_id) AS total
                         FROM page_counts GROUP BY 1) last ON last.address = split_part(p.url, '#', 1)
UNION ALL SELECT 'http://nowhere.test/' || page_id, 'failed', 0, 0, 'page not found' FROM pages"""
SQL["site_request_results"] = VISITS + """
SELECT min(CASE WHEN level = 0 AND rank = 1 THEN v.url END) AS url, 'completed' AS status,
       CAST(count(*) AS INTEGER) AS pages_scanned, CAST(count(x.url) AS INTEGER) AS total_issues
FROM visits v LEFT JOIN (SELECT url FROM node_url WHERE i % 3 = 0) x ON x.url = v.url AND outcome = 'ok' GROUP BY site"""

SQL["served_run_pages"] = REQUEST_VISITS + """
SELECT request, url, rank, CAST(coalesce(missing_alt, false) AS INTEGER) AS total, CASE WHEN missing_alt THEN 'IMG_MISSING_ALT critical' ELSE '' END AS issues
FROM scanned WHERE outcome = 'ok'
UNION ALL SELECT 1000000 + i, url, 1, CAST(i % 3 = 0 AS INTEGER), CASE WHEN i % 3 = 0 THEN 'IMG_MISSING_ALT critical' ELSE '' END FROM node_url"""
SQL["served_runs"] = REQUEST_VISITS + """
SELECT request, r.url, 'completed' AS status, CAST(n AS INTEGER) AS pages_scanned, CAST(found AS INTEGER) AS total_issues,
       CAST(NULL AS VARCHAR) AS error, true AS in_order
FROM requests r JOIN (SELECT request, count(*) AS n, count(*) FILTER (missing_alt) AS found FROM scanned WHERE outcome = 'ok' GROUP BY 1)
  USING (request)
UNION ALL SELECT 1000000 + i, url, 'completed', 1, CAST(i % 3 = 0 AS INTEGER), NULL, true FROM node_url
UNION ALL SELECT 2000000 + i, 'http://nowhere.test/' || i, 'failed', 0, 0, 'page not found', true FROM node_url"""

# Slices of five days arrive one after the other, some rows two or three slices late; an address is known for six days past the watermark.
SQL["stream_seen_again"] = """
WITH RECURSIVE late AS (
  SELECT 'http://user.test/' || user_id AS url, ts, CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS BIGINT) // 432000000000
         + CASE event_id % 17 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END AS slice FROM events),
arrived AS (SELECT slice, url, min(ts) AS ts FROM late GROUP BY ALL),
marks AS (
  SELECT slice, (SELECT max(a.ts) FROM arrived a WHERE a.slice < s.slice - 1) - INTERVAL 6 DAY AS mark FROM (SELECT DISTINCT slice FROM arrived) s),
timely AS (
  SELECT url, ts, mark, row_number() OVER (PARTITION BY url ORDER BY slice) AS n FROM arrived JOIN marks USING (slice)
  WHERE mark IS NULL OR ts > mark),
walk AS (
  SELECT url, n, ts, ts AS known, true AS fresh FROM timely WHERE n = 1
  UNION ALL
  SELECT t.url, t.n, t.ts, CASE WHEN w.known + INTERVAL 6 DAY <= t.mark THEN t.ts ELSE w.known END,
         coalesce(w.known + INTERVAL 6 DAY <= t.mark, false)
  FROM walk w JOIN timely t ON t.url = w.url AND t.n = w.n + 1)
SELECT url, ts AS seen FROM walk WHERE fresh"""

SQL["site_prompts"] = """
SELECT site, 'You are an accessibility expert. Given the site HTML and list of issues, '
       || 'provide concise, actionable fixes for each issue.' || chr(10) || chr(10) || 'Found issues: []' || chr(10) || chr(10)
       || 'HTML snippet (truncated):' || chr(10) || substring(string_agg(url, chr(10) ORDER BY page_id), 1, 4000) AS prompt
FROM (SELECT 'http://s' || (page_id % 3) || '.test/' || url AS url, page_id, 's' || (page_id % 3) || '.test' AS site FROM pages) GROUP BY site"""

# The planted page as the parser writes it, and its edits.
PARSED = WITH_EXPECTED + """
, edited AS (SELECT page_id, url, k, CASE k """ + " ".join(
    f"WHEN {k} THEN replace(html, {q(a)}, {q(b)})"
    for k, (a, b) in ({k: ("<footer>", x + "<footer>") for k, x in SNIPPETS.items()} | EDITS).items()
) + """ ELSE html END AS html FROM planted),
closed AS (
  SELECT page_id, url, k, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(html,
    '<!DOCTYPE html>', '<!DOCTYPE html>' || chr(10)), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'),
    '<(img|input|meta|track|br)([^>]*[^/>])?>', '<\\1\\2/>', 'g'), '<br/>(<p>|</ar|</main)', '<br/></b></p>\\1', 'g'),
    ' (autoplay|muted|controls|hidden|loop)([ />])', ' \\1=""\\2', 'g'), ' (autoplay|muted|controls|hidden|loop)([ />])', ' \\1=""\\2', 'g') AS html
  FROM edited),
parsed AS (SELECT page_id, url, k, html || CASE WHEN contains(html, '</body>') THEN '' ELSE '</body>' END
                  || CASE WHEN contains(html, '</html>') THEN '' ELSE '</html>' END AS html FROM closed),
edits(k, old, new) AS (VALUES
  (1, '<img src="logo.png"/>', '<img src="logo.png" alt="logo.png"/>'), (2, '<img src="i.png"/>', '<img src="i.png" alt="Icon"/>'),
  (3, '<img src="b.png" alt="  "/>', '<img src="b.png" alt="b.png"/>'),
  (7, '<p style="color: #777777; background-color: #ffffff">', '<p style="color: #000000;  background-color: #ffffff">'))
"""
SQL["fixed_pages"] = PARSED + """
SELECT page_id, url, CASE WHEN old IS NULL THEN html ELSE replace(html, old, new) END AS fixed_html FROM parsed LEFT JOIN edits USING (k)"""
SQL["undone_pages"] = PARSED + "SELECT page_id, url, html FROM parsed"
SQL["fix_edits"] = PARSED + """
SELECT page_id, 0 AS pos, CAST(strpos(html, old) - 1 AS INTEGER) AS at, old, new FROM parsed JOIN edits USING (k)"""
