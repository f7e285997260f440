"""Column expressions over text: lines, languages, prompts and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extension to language name.
LANGUAGES = {
    ".py": "python",
    ".java": "java",
    ".js": "javascript",
    ".ts": "typescript",
    ".c": "c",
    ".cpp": "cpp",
    ".cs": "csharp",
    ".rb": "ruby",
    ".php": "php",
    ".go": "go",
    ".rs": "rust",
}

# The last extension of the file name; leading dots do not start one.
_EXTENSION = r"(?:^|/)\.*[^/.][^/]*?(\.[^/.]*)$"

# One triple-quoted string and nothing else. Possessive groups, so that long texts cannot exhaust the stack.
_ONE_DOCSTRING = (
    r'(?s)^\s*+(?:"""[^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+"""'
    r"|'''[^'\\]*+(?:(?:\\.|'(?!''))[^'\\]*+)*+''')\s*+$"
)

# A line that begins with neither a comment nor white space only; line by line, so that blank lines cost no more.
_CODE_LINE = r"(?m)^[^\S\n]*+[^#\s]"


def line_array(content: Column) -> Column:
    """The lines of a text. A final line break ends the last line and does not start another."""
    body = F.regexp_replace(content, r"\r?\n\z", "")
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n"))


def strip_ws(text: Column) -> Column:
    """Drop white space of every kind at both ends (``trim`` drops spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def language_of(path: Column) -> Column:
    """Language by extension, null when unknown. Extensions are case-sensitive."""
    table = F.create_map(*[F.lit(part) for pair in LANGUAGES.items() for part in pair])
    return F.try_element_at(table, F.regexp_extract(path, _EXTENSION, 1))


def fill_prompt(template: str | Column, language: Column, code: Column) -> Column:
    """Fill ``{program_language}`` and ``{code}``. Code goes in last, so braces inside it stay as they are."""
    text = F.lit(template) if isinstance(template, str) else template
    return F.replace(F.replace(text, F.lit("{program_language}"), language), F.lit("{code}"), code)


def is_comment_only(answer: Column) -> Column:
    """True when an answer holds one triple-quoted string, or nothing but ``#`` comments and blank lines."""
    return answer.rlike(_ONE_DOCSTRING) | ~answer.rlike(_CODE_LINE)
