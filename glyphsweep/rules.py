"""The rule data every operator is generated from.

Nothing here runs on Spark: code-point ranges, name lists and patterns are plain
values, and the regexes, CASE expressions and rule tables elsewhere in the
package are all built from them, so finding and cleaning cannot disagree.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

BOM = 0xFEFF
ZWJ = 0x200D


@dataclass(frozen=True)
class CharRule:
    """Code-point ranges (inclusive) of one category and what replaces them."""

    category: str
    ranges: tuple[tuple[int, int], ...]
    replacement: str = ""


@dataclass(frozen=True)
class LineRule:
    """One pattern that marks a commit-message line or a comment."""

    rule_id: str
    family: str
    regex: str


@dataclass(frozen=True)
class CommentSyntax:
    """How comments are written in files with a given extension."""

    ext: str
    line_token: str
    block_open: str | None = None
    block_close: str | None = None
    doc_open: str | None = None
    doc_close: str | None = None
    html: bool = False


def _ranges(text: str) -> tuple[tuple[int, int], ...]:
    """Parse ``"00A0 2000-200A"`` into inclusive code-point ranges."""
    bounds = (part.partition("-") for part in text.split())
    return tuple((int(lo, 16), int(hi or lo, 16)) for lo, _, hi in bounds)


# --- Fixed values: code points by category ---------------------------------------

EXOTIC_SPACE = CharRule("exotic-space", _ranges("00A0 1680 2000-200A 202F 205F 3000"), " ")
SEPARATOR = CharRule("separator", _ranges("2028-2029"), "\n")
ZERO_WIDTH = CharRule(
    "zero-width",
    _ranges("00AD 034F 115F-1160 17B4-17B5 180E 200B-200D 2060 3164 FEFF FFA0 FFF9-FFFB"),
)
BIDI_CONTROL = CharRule("bidi-control", _ranges("061C 200E-200F 202A-202E 2066-206F"))
TAG_BLOCK = CharRule("tag-block", _ranges("E0000-E007F"))
VARIATION_SELECTOR = CharRule("variation-selector", _ranges("FE00-FE0F E0100-E01EF"))
INVISIBLE_MATH = CharRule("invisible-math", _ranges("2061-2064"))

HIDDEN_RULES = (
    ZERO_WIDTH,
    BIDI_CONTROL,
    TAG_BLOCK,
    VARIATION_SELECTOR,
    INVISIBLE_MATH,
    EXOTIC_SPACE,
    SEPARATOR,
)

TYPOGRAPHY_FOLDS = {
    0x2013: "-",
    0x2014: "--",
    0x2015: "--",
    0x2018: "'",
    0x2019: "'",
    0x201A: "'",
    0x201B: "'",
    0x201C: '"',
    0x201D: '"',
    0x201E: '"',
    0x201F: '"',
    0x2026: "...",
    0x2032: "'",
    0x2033: '"',
    0x2212: "-",
}

CATEGORIES = (
    "zero-width",
    "bidi-control",
    "tag-block",
    "variation-selector",
    "invisible-math",
    "exotic-space",
    "separator",
    "typography",
)
UNKNOWN_CATEGORY = "unknown"

# White space that makes a line blank (Unicode White_Space).
BLANK_RANGES = _ranges("0009-000D 0020 0085 00A0 1680 2000-200A 2028-2029 202F 205F 3000")

# --- Fixed values: commit-message line patterns (RE2 syntax, case-insensitive) -----

COMMIT_PATTERNS = {
    "claude": (
        r"Co-Authored-By:\s*Claude\s*<.*@anthropic\.com>",
        r"Co-Authored-By:.*@anthropic\.com",
        r"Co-Authored-By:.*\bclaude\b.*",
        r".*Generated with.*Claude.*",
        r".*\[Claude( Code)?\].*",
        r".*\(Claude( Code)?\).*",
        r".*Created (with|by).*Claude.*",
        r".*Built (with|by).*Claude.*",
        r".*Assisted by.*Claude.*",
        r".*claude\.com.*",
        r".*claude\.ai.*",
        r".*anthropic\.com.*",
    ),
    "openai": (
        r"Co-Authored-By:\s*Codex\s*<.*>",
        r"Co-Authored-By:\s*ChatGPT\s*<.*>",
        r"Co-Authored-By:.*@openai\.com",
        r"Co-Authored-By:.*\bcodex\b.*",
        r"Co-Authored-By:.*\bchatgpt\b.*",
        r".*Generated with.*Codex.*",
        r".*Generated with.*ChatGPT.*",
        r".*\[Codex( CLI)?\].*",
        r".*\(Codex( CLI)?\).*",
        r".*Created (with|by).*Codex.*",
        r".*Built (with|by).*Codex.*",
        r".*Assisted by.*Codex.*",
        r".*chatgpt\.com.*",
        r".*chat\.openai\.com.*",
        r".*openai\.com.*",
    ),
    "emoji": (
        r"[🤖🔧✨].*\b(generated|created|built|powered).*",
        r"🤖.*Claude.*",
        r"🤖.*Anthropic.*",
        r"🤖.*Codex.*",
        r"🤖.*OpenAI.*",
    ),
    "generic": (
        r".*\bAI[-\s]+(assisted|generated|created|powered)\b.*",
        r".*(Generated|Created|Built|Powered)\s+(with|by)\s+AI\b.*",
    ),
    "signature": (r".*-\s*(Claude|Anthropic|Codex|ChatGPT|OpenAI)(\s|$).*",),
}

# --- Fixed values: comment tokens (RE2 syntax, case-insensitive) -------------------

COMMENT_TOKENS = (
    r"\bclaude\b",
    r"\banthropic\b",
    r"claude\.ai",
    r"claude\.com",
    r"anthropic\.com",
    r"\bcodex\b",
    r"\bchatgpt\b",
    r"\bopenai\b",
    r"openai\.com",
    r"chatgpt\.com",
    r"\bai[-\s]+(assisted|generated|created|powered)\b",
    r"\b(generated|created|built|powered)\s+(with|by)\s+(ai|claude|codex|chatgpt|openai|anthropic)\b",
    r"\b(generated|assisted)\s+(with|by)\b",
)

# --- Fixed values: path rules ------------------------------------------------------

TOOL_DIRS = (".claude", ".codex", ".cursor", ".continue", ".aider")
UNVISITED_DIRS = (".git", "node_modules", "vendor")
DOC_DIRS = ("docs", "doc", "adr")
TOOL_FILES = (
    "CLAUDE.md",
    "AGENTS.md",
    ".mcp.json",
    ".claude.json",
    ".claudeignore",
    ".cursorrules",
    ".cursorignore",
    ".aider.conf.yml",
    ".aider.input.history",
    ".aider.chat.history.md",
)
TOOL_PATHS = (".github/copilot-instructions.md",)
OWNED_MARKDOWN = ("claude.md", "agents.md", ".aider.chat.history.md", "copilot-instructions.md")
PROSE_EXTENSIONS = (".md", ".markdown", ".mdx", ".txt", ".rst", ".adoc", ".asciidoc")

# --- Fixed values: comment syntax by extension -------------------------------------

_C_STYLE = dict(line_token="//", block_open="/*", block_close="*/")
COMMENT_SYNTAX = (
    CommentSyntax(".go", **_C_STYLE),
    CommentSyntax(".js", **_C_STYLE, html=True),
    CommentSyntax(".jsx", **_C_STYLE, html=True),
    CommentSyntax(".ts", **_C_STYLE, html=True),
    CommentSyntax(".tsx", **_C_STYLE, html=True),
    CommentSyntax(".java", **_C_STYLE),
    CommentSyntax(".c", **_C_STYLE),
    CommentSyntax(".cpp", **_C_STYLE),
    CommentSyntax(".h", **_C_STYLE),
    CommentSyntax(".hpp", **_C_STYLE),
    CommentSyntax(".rs", **_C_STYLE),
    CommentSyntax(".cs", **_C_STYLE),
    CommentSyntax(".php", **_C_STYLE),
    CommentSyntax(".py", line_token="#", doc_open='"""', doc_close='"""'),
    CommentSyntax(".rb", line_token="#"),
)
SOURCE_EXTENSIONS = tuple(s.ext for s in COMMENT_SYNTAX)

# --- Fixed values: cleaning steps in the order they run ------------------------------

STEPS = {
    "history": "drop generation footers from commit messages",
    "artifacts": "remove tool directories and instruction files",
    "markdown": "remove generic Markdown outside the documentation directories",
    "comments": "strip marked comments from source files",
    "watermarks": "strip hidden characters from text files",
}
STEP_ORDER = {step: i for i, step in enumerate(STEPS, start=1)}

# The directory saved originals live in is ours to name; it is never cleaned.
STORE_DIR = ".glyphsweep"

# Every built-in commit pattern and comment token contains one of these words or,
# where it spells an "s", possibly U+017F, which folds to it. A text without any of
# them cannot match, and substring search is far cheaper than the patterns.
TRACE_WORDS = (
    "claude",
    "anthropic",
    "codex",
    "chatgpt",
    "openai",
    "assisted",
    "generated",
    "created",
    "built",
    "powered",
    "\u017f",
)


def commit_rules(
    extra: Iterable[LineRule] = (), exclude: Iterable[str] = ()
) -> tuple[LineRule, ...]:
    """The commit-message rules, with ids ``<family>-<n>`` in list order."""
    dropped = set(exclude)
    built_in = (
        LineRule(f"{family}-{n}", family, regex)
        for family, patterns in COMMIT_PATTERNS.items()
        for n, regex in enumerate(patterns, start=1)
    )
    rules = [*built_in, *extra]
    unknown = dropped - {r.rule_id for r in rules} - {r.family for r in rules}
    if unknown:
        raise ValueError(f"unknown rule or family to exclude: {sorted(unknown)}")
    return tuple(r for r in rules if r.rule_id not in dropped and r.family not in dropped)


def comment_rules(
    extra: Iterable[LineRule] = (), exclude: Iterable[str] = ()
) -> tuple[LineRule, ...]:
    """The comment tokens as rules, with ids ``token-<n>`` in list order."""
    dropped = set(exclude)
    built_in = (LineRule(f"token-{n}", "token", t) for n, t in enumerate(COMMENT_TOKENS, start=1))
    rules = [*built_in, *extra]
    unknown = dropped - {r.rule_id for r in rules}
    if unknown:
        raise ValueError(f"unknown comment token to exclude: {sorted(unknown)}")
    return tuple(r for r in rules if r.rule_id not in dropped)


def typography_rules() -> tuple[CharRule, ...]:
    """The typography folds as one rule per replacement text."""
    by_replacement: dict[str, list[tuple[int, int]]] = {}
    for cp, text in TYPOGRAPHY_FOLDS.items():
        by_replacement.setdefault(text, []).append((cp, cp))
    return tuple(CharRule("typography", tuple(r), text) for text, r in by_replacement.items())


def hidden_rules(
    typography: bool = False,
    keep_zwj: bool = False,
    keep_variation_selectors: bool = False,
    extra: Iterable[CharRule] = (),
) -> tuple[CharRule, ...]:
    """The character rules in force for one set of options."""
    rules = []
    for rule in HIDDEN_RULES:
        if rule is VARIATION_SELECTOR and keep_variation_selectors:
            continue
        if rule is ZERO_WIDTH and keep_zwj:
            rule = CharRule(rule.category, without(rule.ranges, ZWJ), rule.replacement)
        rules.append(rule)
    if typography:
        rules.extend(typography_rules())
    return (*rules, *extra)


def without(ranges: Iterable[tuple[int, int]], cp: int) -> tuple[tuple[int, int], ...]:
    """``ranges`` with one code point taken out."""
    kept = []
    for lo, hi in ranges:
        if lo <= cp <= hi:
            kept += [(a, b) for a, b in ((lo, cp - 1), (cp + 1, hi)) if a <= b]
        else:
            kept.append((lo, hi))
    return tuple(kept)
