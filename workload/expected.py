"""What the comparison expects, spelled out apart from the engine's own rules.

Fixed values. A rule lost or misspelled on either side makes queries and tests differ.
"""

# Patterns of commit-message lines by family, in RE2 syntax, case-insensitive.
COMMIT_PATTERNS = {
    "claude": [
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
    ],
    "openai": [
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
    ],
    "emoji": [
        r"[🤖🔧✨].*\b(generated|created|built|powered).*",
        r"🤖.*Claude.*",
        r"🤖.*Anthropic.*",
        r"🤖.*Codex.*",
        r"🤖.*OpenAI.*",
    ],
    "generic": [
        r".*\bAI[-\s]+(assisted|generated|created|powered)\b.*",
        r".*(Generated|Created|Built|Powered)\s+(with|by)\s+AI\b.*",
    ],
    "signature": [
        r".*-\s*(Claude|Anthropic|Codex|ChatGPT|OpenAI)(\s|$).*",
    ],
}

# Tokens that mark a comment, likewise.
COMMENT_TOKENS = [
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
]

# First and last code points of every range by category, and what replaces them.
CODE_POINTS = [
    ("zero-width", 0x00AD, 0x00AD, ''),
    ("zero-width", 0x034F, 0x034F, ''),
    ("zero-width", 0x115F, 0x1160, ''),
    ("zero-width", 0x17B4, 0x17B5, ''),
    ("zero-width", 0x180E, 0x180E, ''),
    ("zero-width", 0x200B, 0x200D, ''),
    ("zero-width", 0x2060, 0x2060, ''),
    ("zero-width", 0x3164, 0x3164, ''),
    ("zero-width", 0xFEFF, 0xFEFF, ''),
    ("zero-width", 0xFFA0, 0xFFA0, ''),
    ("zero-width", 0xFFF9, 0xFFFB, ''),
    ("bidi-control", 0x061C, 0x061C, ''),
    ("bidi-control", 0x200E, 0x200F, ''),
    ("bidi-control", 0x202A, 0x202E, ''),
    ("bidi-control", 0x2066, 0x206F, ''),
    ("tag-block", 0xE0000, 0xE007F, ''),
    ("variation-selector", 0xFE00, 0xFE0F, ''),
    ("variation-selector", 0xE0100, 0xE01EF, ''),
    ("invisible-math", 0x2061, 0x2064, ''),
    ("exotic-space", 0x00A0, 0x00A0, ' '),
    ("exotic-space", 0x1680, 0x1680, ' '),
    ("exotic-space", 0x2000, 0x200A, ' '),
    ("exotic-space", 0x202F, 0x202F, ' '),
    ("exotic-space", 0x205F, 0x205F, ' '),
    ("exotic-space", 0x3000, 0x3000, ' '),
    ("separator", 0x2028, 0x2029, '\n'),
    ("typography", 0x2013, 0x2013, '-'),
    ("typography", 0x2014, 0x2014, '--'),
    ("typography", 0x2015, 0x2015, '--'),
    ("typography", 0x2018, 0x2018, "'"),
    ("typography", 0x2019, 0x2019, "'"),
    ("typography", 0x201A, 0x201A, "'"),
    ("typography", 0x201B, 0x201B, "'"),
    ("typography", 0x201C, 0x201C, '"'),
    ("typography", 0x201D, 0x201D, '"'),
    ("typography", 0x201E, 0x201E, '"'),
    ("typography", 0x201F, 0x201F, '"'),
    ("typography", 0x2026, 0x2026, '...'),
    ("typography", 0x2032, 0x2032, "'"),
    ("typography", 0x2033, 0x2033, '"'),
    ("typography", 0x2212, 0x2212, '-'),
]

# Names that decide what becomes of a path, likewise.
TOOL_FOLDERS = [".claude", ".codex", ".cursor", ".continue", ".aider"]
CLOSED_FOLDERS = [".git", "node_modules", "vendor", ".glyphsweep"]
DOC_FOLDERS = ["docs", "doc", "adr"]
TOOL_NAMES = [
    "CLAUDE.md", "AGENTS.md", ".mcp.json", ".claude.json", ".claudeignore", ".cursorrules", ".cursorignore",
    ".aider.conf.yml", ".aider.input.history", ".aider.chat.history.md",
]
TOOL_PATH = ".github/copilot-instructions.md"
SOURCE_STYLES = {
    "go": [".go", ".java", ".c", ".cpp", ".h", ".hpp", ".rs", ".cs", ".php"],
    "ts": [".js", ".jsx", ".ts", ".tsx"],
    "py": [".py"],
    "rb": [".rb"],
}
PROSE = [".md", ".markdown", ".mdx", ".txt", ".rst", ".adoc", ".asciidoc"]
