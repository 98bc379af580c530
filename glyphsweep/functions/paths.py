"""Path functions and predicates. Paths are repository-relative, separated by ``/``."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphsweep.functions.bind import as_column
from glyphsweep.rules import (
    DOC_DIRS,
    OWNED_MARKDOWN,
    PROSE_EXTENSIONS,
    SOURCE_EXTENSIONS,
    STORE_DIR,
    TOOL_DIRS,
    TOOL_FILES,
    TOOL_PATHS,
    UNVISITED_DIRS,
)


def base_name(path: Column | str) -> Column:
    """The last segment of the path."""
    return F.substring_index(as_column(path), "/", -1)


def dir_name(path: Column | str) -> Column:
    """The path without its last segment, ``.`` for a file at the root."""
    path = as_column(path)
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(
        F.lit(".")
    )


def extension(path: Column | str) -> Column:
    """The lower-case extension with its dot; a leading-dot name is all extension."""
    base = base_name(path)
    return F.when(
        F.contains(base, F.lit(".")), F.concat(F.lit("."), F.lower(F.substring_index(base, ".", -1)))
    ).otherwise(F.lit(""))


def relative_path(path: Column | str, root: str) -> Column:
    """``path`` below ``root``; a path outside it is returned as it is."""
    path = as_column(path)
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def parent_dirs(path: Column | str) -> Column:
    """The names of all directories the file lies in, outermost first."""
    parts = F.split(as_column(path), "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def _under_any(path: Column | str, names: Iterable[str]) -> Column:
    return F.arrays_overlap(parent_dirs(path), F.array(*[F.lit(n) for n in names]))


def in_skipped_dir(path: Column | str, store_dir: str = STORE_DIR) -> Column:
    """Whether any parent directory is one the cleaning steps never enter."""
    return _under_any(path, (*UNVISITED_DIRS, store_dir, *TOOL_DIRS))


def in_docs(path: Column | str) -> Column:
    """Whether the file lies in a documentation directory at any depth."""
    return _under_any(path, DOC_DIRS)


def in_tool_dir(path: Column | str, root_only: bool = True) -> Column:
    """Whether the file lies in a tool directory, at the root or anywhere."""
    path = as_column(path)
    if not root_only:
        return _under_any(path, TOOL_DIRS)
    return F.contains(path, F.lit("/")) & F.substring_index(path, "/", 1).isin(*TOOL_DIRS)


def is_tool_file(path: Column | str) -> Column:
    """Whether the file is a tool file by exact name, or a tool file by exact path."""
    path = as_column(path)
    return base_name(path).isin(*TOOL_FILES) | path.isin(*TOOL_PATHS)


def is_markdown(path: Column | str) -> Column:
    """Whether the file is Markdown the markdown rule may remove.

    The README at the root and the names the tool-file rule owns are exempt.
    """
    lowered = F.lower(as_column(path))
    name = base_name(lowered)
    return name.endswith(".md") & (lowered != "readme.md") & ~name.isin(*OWNED_MARKDOWN)


def is_source(path: Column | str) -> Column:
    """Whether the extension is that of a source file with known comment syntax."""
    return extension(path).isin(*SOURCE_EXTENSIONS)


def is_prose(path: Column | str) -> Column:
    """Whether the extension is that of a prose file."""
    return extension(path).isin(*PROSE_EXTENSIONS)


def removed_as_artifact(
    path: Column | str, root_only: bool = True, store_dir: str = STORE_DIR
) -> Column:
    """Whether the artifacts step removes the file."""
    path = as_column(path)
    named = base_name(path).isin(*TOOL_FILES) & ~in_skipped_dir(path, store_dir)
    return in_tool_dir(path, root_only) | named | path.isin(*TOOL_PATHS)


def removed_as_markdown(path: Column | str, store_dir: str = STORE_DIR) -> Column:
    """Whether the markdown step removes the file."""
    return is_markdown(path) & ~in_skipped_dir(path, store_dir) & ~in_docs(path)
