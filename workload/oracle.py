"""Comparison SQL for the registered queries, for DuckDB on the same tables.

Written from the rules' description, not from the Spark expressions: character
classes and path lists are spelled out here again, positions come from unnested
characters, and the patterns are used as RE2 reads them.
"""

from __future__ import annotations

from workload.expected import COMMENT_TOKENS, COMMIT_PATTERNS
from workload.plant import BYTES_SQL, COMMITS_SQL, DENSE_SQL, DOCS_SQL, FILES_SQL, STRAY_CLASS

# Code points by category, as RE2 classes.
SPACE = r"\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
SEPARATOR = r"\x{2028}\x{2029}"
ZERO_WIDTH_BUT_JOINER = (
    r"\x{AD}\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180E}\x{200B}\x{200C}\x{2060}\x{3164}"
    r"\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}"
)
JOINER = r"\x{200D}"
BIDI = r"\x{61C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{206F}"
TAGS = r"\x{E0000}-\x{E007F}"
SELECTORS = r"\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}"
MATH = r"\x{2061}-\x{2064}"
TYPOGRAPHY = r"\x{2013}-\x{2015}\x{2018}-\x{201F}\x{2026}\x{2032}\x{2033}\x{2212}"
CLASSES = {
    "zero-width": ZERO_WIDTH_BUT_JOINER + JOINER,
    "bidi-control": BIDI,
    "tag-block": TAGS,
    "variation-selector": SELECTORS,
    "invisible-math": MATH,
    "exotic-space": SPACE,
    "separator": SEPARATOR,
    "typography": TYPOGRAPHY,
}
BLANK = (
    r"[\x{9}-\x{D} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def hidden(typography: bool = False, zwj: bool = False, selectors: bool = False) -> str:
    parts = [ZERO_WIDTH_BUT_JOINER, BIDI, TAGS, MATH, SPACE, SEPARATOR]
    parts += [] if zwj else [JOINER]
    parts += [] if selectors else [SELECTORS]
    parts += [TYPOGRAPHY] if typography else []
    return f"[{''.join(parts)}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def body(text: str) -> str:
    """The text without a leading byte-order mark, which is never a hit."""
    return f"(CASE WHEN starts_with({text}, chr(65279)) THEN substr({text}, 2) ELSE {text} END)"


def lead(text: str) -> str:
    return f"(CASE WHEN starts_with({text}, chr(65279)) THEN chr(65279) ELSE '' END)"


def dirty(text: str, **opts) -> str:
    return f"regexp_matches({body(text)}, {q(hidden(**opts))})"


def count(text: str, cls: str) -> str:
    return f"len(regexp_extract_all({body(text)}, {q(cls)}))"


def strip(text: str, typography: bool = False, zwj: bool = False, selectors: bool = False) -> str:
    deleted = ZERO_WIDTH_BUT_JOINER + BIDI + TAGS + MATH
    deleted += ("" if zwj else JOINER) + ("" if selectors else SELECTORS)
    e = f"regexp_replace({body(text)}, {q(f'[{deleted}]')}, '', 'g')"
    e = f"regexp_replace({e}, {q(f'[{SPACE}]')}, ' ', 'g')"
    e = f"regexp_replace({e}, {q(f'[{SEPARATOR}]')}, chr(10), 'g')"
    if typography:
        e = f"regexp_replace({e}, {q(r'[\x{2014}\x{2015}]')}, '--', 'g')"
        e = f"regexp_replace({e}, {q(r'[\x{2013}\x{2212}]')}, '-', 'g')"
        e = f"regexp_replace({e}, {q(r'[\x{2018}-\x{201B}\x{2032}]')}, '''', 'g')"
        e = f"regexp_replace({e}, {q(r'[\x{201C}-\x{201F}\x{2033}]')}, '\"', 'g')"
        e = f"regexp_replace({e}, {q(r'[\x{2026}]')}, '...', 'g')"
    return f"({lead(text)} || {e})"


def category(ch: str) -> str:
    cases = " ".join(
        f"WHEN regexp_full_match({ch}, {q(f'[{cls}]')}) THEN '{name}'" for name, cls in CLASSES.items()
    )
    return f"CASE {cases} ELSE 'unknown' END"


def findings(source: str, keys: str = "doc_id", text: str = "text", size: str = "strlen(ch)", **opts) -> str:
    """CTEs ending in ``found``: one row per hit, by unnested characters and windows."""
    return f"""
    chars AS (
      SELECT {keys}, unnest(cs) AS ch, unnest(range(1, len(cs) + 1)) AS i
      FROM (SELECT {keys}, regexp_extract_all({text}, '(?s).') AS cs FROM {source})),
    placed AS (
      SELECT {keys}, ch, i,
        coalesce(sum({size}) OVER before, 0) AS "offset",
        1 + coalesce(sum((ch = chr(10))::INT) OVER before, 0) AS line,
        i - coalesce(max(CASE WHEN ch = chr(10) THEN i END) OVER before, 0) AS col
      FROM chars
      WINDOW before AS (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    found AS (
      SELECT {keys}, unicode(ch)::BIGINT AS rune, printf('U+%04X', unicode(ch)) AS u,
        "offset"::BIGINT AS "offset", line::BIGINT AS line, col::BIGINT AS col,
        {category("ch")} AS category
      FROM placed
      WHERE regexp_full_match(ch, {q(hidden(**opts))}) AND NOT (i = 1 AND ch = chr(65279)))"""


# --- Commit messages -----------------------------------------------------------------

RULES = [
    (f"{family}-{n}", family, p)
    for family, patterns in COMMIT_PATTERNS.items()
    for n, p in enumerate(patterns, start=1)
]


def trace(line: str, rules=RULES) -> str:
    return f"regexp_matches({line}, {q('(?i)' + '|'.join(f'(?:{p})' for _, _, p in rules))})"


def normalized(text: str) -> str:
    inner = rf"\n{BLANK}*$"
    whole = rf"^{BLANK}*$"
    return (
        f"(CASE WHEN regexp_matches({text}, {q(whole)}) THEN '' "
        f"ELSE regexp_replace({text}, {q(inner)}, '') END || chr(10))"
    )


def kept_lines(text: str, rules=RULES) -> str:
    return (
        f"array_to_string(list_filter(string_split({text}, chr(10)), "
        f"lambda l: NOT {trace('l', rules)}), chr(10))"
    )


# --- Comments ------------------------------------------------------------------------

AI = "(?i)" + "|".join(f"(?:{t})" for t in COMMENT_TOKENS)
QUOTED = r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`[^`]*`"""
SLASH_LINE = rf"""(?s)^((?:/?(?:[^"'`/]|{QUOTED}))*?)(//.*)$"""
HASH_LINE = rf"""(?s)^((?:[^"'`#]|{QUOTED})*?)(#.*)$"""


def is_blank(text: str) -> str:
    return f"regexp_full_match({text}, {q(BLANK + '*')})"


def blocks(name: str, source: str, span: str, keys: str) -> str:
    """CTEs ending in ``name``: ``text`` of ``source`` without its marked spans."""
    return f"""
    {name}_p AS (
      SELECT {keys}, text, string_split_regex(text, {q(span)}) AS g,
        regexp_extract_all(text, {q(span)}) AS b FROM {source}),
    {name}_s AS (
      SELECT *, list_transform(b, lambda x, i: CASE
        WHEN NOT regexp_matches(x, {q(AI)}) THEN 0
        WHEN {is_blank("split_part(g[i], chr(10), -1)")} THEN 1 ELSE 2 END) AS v FROM {name}_p),
    {name}_g AS (
      SELECT *, list_transform(g, lambda x, i:
        CASE WHEN i > 1 AND v[i - 1] = 1 AND starts_with(x, chr(10)) THEN substr(x, 2) ELSE x END) AS h
      FROM {name}_s),
    {name} AS (
      SELECT {keys}, array_to_string(list_transform(h, lambda x, i: CASE
        WHEN i > len(b) THEN x
        WHEN v[i] = 0 THEN x || b[i]
        WHEN v[i] = 1 THEN regexp_replace(x, '[^\\n]*$', '')
        ELSE rtrim(x, ' ' || chr(9)) END), '') AS text
      FROM {name}_g)"""


def line_comments(name: str, source: str, pattern: str, keys: str) -> str:
    p = q(pattern)
    return f"""
    {name} AS (
      SELECT {keys}, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: CASE
        WHEN NOT regexp_matches(l, {p}) THEN l
        WHEN NOT regexp_matches(regexp_extract(l, {p}, 2), {q(AI)}) THEN l
        WHEN {is_blank(f"regexp_extract(l, {p}, 1)")} THEN NULL
        ELSE rtrim(regexp_extract(l, {p}, 1), ' ' || chr(9)) END), lambda l: l IS NOT NULL), chr(10)) AS text
      FROM {source})"""


def collapsed(text: str) -> str:
    lines = f"string_split({text}, chr(10))"
    return (
        f"array_to_string(list_filter({lines}, lambda l, i: i = 1 OR NOT ({is_blank('l')} "
        f"AND {is_blank(lines + '[i - 1]')})), chr(10))"
    )


BLOCK = r"(?s)/\*.*?\*/"
DOC = '(?s)""".*?"""'
HTML = "(?s)<!--.*?-->"


def commented(source: str = "files") -> str:
    """CTEs ending in ``commented``: every file with ``before`` and ``after`` the step."""
    keys = "repo, path"
    return f"""
    go0 AS (SELECT * FROM {source} WHERE regexp_matches(path, '\\.(go|java|c|cpp|h|hpp|rs|cs|php)$')),
    {blocks("go1", "go0", BLOCK, keys)}, {line_comments("go2", "go1", SLASH_LINE, keys)},
    ts0 AS (SELECT * FROM {source} WHERE regexp_matches(path, '\\.(js|jsx|ts|tsx)$')),
    {blocks("ts1", "ts0", BLOCK, keys)}, {blocks("ts2", "ts1", HTML, keys)},
    {line_comments("ts3", "ts2", SLASH_LINE, keys)},
    py0 AS (SELECT * FROM {source} WHERE path LIKE '%.py'),
    {blocks("py1", "py0", DOC, keys)}, {line_comments("py2", "py1", HASH_LINE, keys)},
    rb0 AS (SELECT * FROM {source} WHERE path LIKE '%.rb'),
    {line_comments("rb1", "rb0", HASH_LINE, keys)},
    edited AS (SELECT * FROM go2 UNION ALL SELECT * FROM ts3 UNION ALL SELECT * FROM py2
      UNION ALL SELECT * FROM rb1),
    commented AS (
      SELECT f.repo, f.path, f.mode, f.text AS before,
        CASE WHEN e.text IS NULL OR e.text = f.text THEN f.text ELSE {collapsed("e.text")} END AS after
      FROM {source} f LEFT JOIN edited e USING (repo, path))"""


# --- Paths ---------------------------------------------------------------------------

BASE = "split_part(path, '/', -1)"
PARENTS = "string_split(path, '/')[:-2]"
SKIPPED = (
    f"list_has_any({PARENTS}, ['.git', 'node_modules', 'vendor', '.glyphsweep', "
    "'.claude', '.codex', '.cursor', '.continue', '.aider'])"
)
TOOL_DIR = "regexp_matches(path, '^\\.(claude|codex|cursor|continue|aider)/')"
TOOL_NAME = (
    f"({BASE} IN ('CLAUDE.md', 'AGENTS.md', '.mcp.json', '.claude.json', '.claudeignore', "
    "'.cursorrules', '.cursorignore', '.aider.conf.yml', '.aider.input.history', "
    "'.aider.chat.history.md'))"
)
TOOL_PATH = "(path = '.github/copilot-instructions.md')"
DOCS_DIR = f"list_has_any({PARENTS}, ['docs', 'doc', 'adr'])"
MARKDOWN = (
    f"(lower({BASE}) LIKE '%.md' AND lower(path) <> 'readme.md' AND lower({BASE}) NOT IN "
    "('claude.md', 'agents.md', '.aider.chat.history.md', 'copilot-instructions.md'))"
)
ARTIFACT = f"({TOOL_DIR} OR {TOOL_PATH} OR ({TOOL_NAME} AND NOT {SKIPPED}))"
GENERIC_MD = f"({MARKDOWN} AND NOT {SKIPPED} AND NOT {DOCS_DIR})"
EXT = f"lower(regexp_extract({BASE}, '\\.[^.]*$'))"
PROSE = f"({EXT} IN ('.md', '.markdown', '.mdx', '.txt', '.rst', '.adoc', '.asciidoc'))"
SOURCE = (
    f"({EXT} IN ('.go', '.js', '.ts', '.jsx', '.tsx', '.py', '.java', '.c', '.cpp', '.h', "
    "'.hpp', '.rs', '.rb', '.php', '.cs'))"
)
CUT = f"({ARTIFACT} OR {GENERIC_MD})"


def staged(typography: bool = False) -> str:
    """CTEs ending in ``staged``: every file with the steps' flags and its new text."""
    hit, new = dirty("after0"), strip("after0")
    if typography:
        hit = f"(CASE WHEN {PROSE} THEN {dirty('after0', typography=True)} ELSE {hit} END)"
        new = f"(CASE WHEN {PROSE} THEN {strip('after0', typography=True)} ELSE {new} END)"
    return f"""{FILES_SQL}, {commented()},
    step0 AS (
      SELECT repo, path, mode, before, {ARTIFACT} AS artifact, {GENERIC_MD} AS markdown,
        NOT {SKIPPED} AND NOT {CUT} AS editable,
        CASE WHEN NOT {SKIPPED} AND NOT {CUT} THEN after ELSE before END AS after0
      FROM commented),
    staged AS (
      SELECT repo, path, mode, before, artifact, markdown, after0 <> before AS commented,
        editable AND {hit} AS hidden,
        CASE WHEN editable THEN {new} ELSE after0 END AS after
      FROM step0)"""


ACTIONS = """
    SELECT 2::BIGINT AS step_ord, 'artifacts' AS step, repo, path, 'remove' AS action FROM staged WHERE artifact
    UNION ALL SELECT 3, 'markdown', repo, path, 'remove' FROM staged WHERE markdown AND NOT artifact
    UNION ALL SELECT 4, 'comments', repo, path, 'rewrite' FROM staged WHERE commented
    UNION ALL SELECT 5, 'watermarks', repo, path, 'rewrite' FROM staged WHERE hidden"""
HISTORY = f"""
    SELECT 1::BIGINT AS step_ord, 'history' AS step, repo, sha AS path, 'rewrite' AS action
    FROM commits WHERE {normalized(kept_lines("message"))} <> {normalized("message")}"""

#: The bytes of a character of ``byte_docs``, and how many they are.
BYTE_SIZE = f"CASE WHEN regexp_full_match(ch, {q(STRAY_CLASS)}) THEN 1 ELSE strlen(ch) END"


def byte_hex(text: str) -> str:
    char = f"CASE WHEN regexp_full_match(c, {q(STRAY_CLASS)}) THEN printf('%02X', unicode(c) - 57344) ELSE hex(encode(c)) END"
    return f"array_to_string(list_transform(regexp_extract_all({text}, '(?s).'), lambda c: {char}), '')"


WITH_DOCS, WITH_DENSE, WITH_BYTES = f"WITH {DOCS_SQL}", f"WITH {DENSE_SQL}", f"WITH {BYTES_SQL}"
WITH_COMMITS, WITH_FILES = f"WITH {COMMITS_SQL}", f"WITH {FILES_SQL}"
