"""Text runs of pages as Arrow arrays: helpers that work on the runs of many pages at once.

Pages are lists of structs.  Here they are flat columns with the number of the page of every run, groups are stretches of
sorted rows, and what is told of a group is a reduction between the places where groups start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space as Java's \s sees it, and what Java's $ may leave behind it.
_SPACE = " \t\n\x0b\f\r"
_OPENS, _CLOSES = r"^[ \t\n\x0B\f\r]", r"[ \t\n\x0B\f\r][\x{85}\x{2028}\x{2029}]?\z"


def flat(pages: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray | pa.Array]]:
    """The page of every run and the runs' columns: numbers and flags as numpy arrays, texts as they are."""
    sizes, runs = pc.fill_null(pc.list_value_length(pages), 0).to_numpy(zero_copy_only=False), pages.flatten()
    columns = {f.name: c if pa.types.is_string(f.type) else c.to_numpy(zero_copy_only=False) for f, c in zip(runs.type, runs.flatten(), strict=True)}
    return np.repeat(np.arange(len(pages)), sizes), columns


def paged(docs: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The document of every page, the pages' numbers and their runs; documents are lists of (page, runs)."""
    sizes, pages = pc.fill_null(pc.list_value_length(docs), 0).to_numpy(zero_copy_only=False), docs.flatten()
    number, runs = pages.flatten()
    return np.repeat(np.arange(len(docs)), sizes), number.to_numpy(zero_copy_only=False), runs


def taken(columns: dict, order: np.ndarray) -> dict:
    return {name: c.take(pa.array(order)) if isinstance(c, pa.Array) else c[order] for name, c in columns.items()}


def changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before in any column; the first row does."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def places(first: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The number of marks since the start of a row's group, the one at the start not counted; groups start with a mark."""
    marks = np.cumsum(first)
    return marks - marks[np.flatnonzero(group)][np.cumsum(group) - 1]


def behind(ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The furthest end of the rows before in a row's group; the first row has none, minus infinity."""
    reach, group = ends, np.cumsum(first)
    if len(ends) and not np.all((ends[1:] >= ends[:-1]) | first[1:]):
        step, longest = 1, int(np.bincount(group).max())
        while step < longest:
            reach = np.concatenate([reach[:step], np.where(group[step:] == group[:-step], np.maximum(reach[step:], reach[:-step]), reach[step:])])
            step *= 2
    out = np.full(len(ends), -np.inf)
    out[1:] = np.where(first[1:], -np.inf, reach[:-1])
    return out


def upper_median(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The middle of every group's sorted values, the upper one of two."""
    if not len(starts):
        return values[:0]
    least = np.minimum.reduceat(values, starts)
    if np.array_equal(least, np.maximum.reduceat(values, starts)):
        return least
    sizes = np.diff(starts, append=len(values))
    ordered = values[np.lexsort((values, np.repeat(np.arange(len(starts)), sizes)))]
    return ordered[starts + sizes // 2]


def line_starts(page: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where lines start among runs sorted by page and y: a line goes by its first run, and runs of one place and size keep together."""
    new, starts = changes(page, y, size) | ~(size > 0), np.zeros(len(page), bool)
    at, own, first_y, first_size = np.flatnonzero(new), -1, 0.0, 0.0
    for k, p, b, z in zip(at.tolist(), page[at].tolist(), y[at].tolist(), size[at].tolist(), strict=True):
        if p == own:
            large, small = (first_size, z) if first_size > z else (z, first_size)
            if abs(first_y - b) < large * (0.6 if small < large * 0.8 else 0.4):
                continue
        starts[k], own, first_y, first_size = True, p, b, z
    return starts


def spaced(texts: pa.Array, x: np.ndarray, end: np.ndarray, size: np.ndarray, first: np.ndarray) -> pa.Array:
    """Texts, with a space before those that stand more than 0.15 sizes behind the ones before in their group."""
    texts = pc.fill_null(texts, "")
    opens, closes = (pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for p in (_OPENS, _CLOSES))
    apart = (x - behind(end, first) > size * 0.15) & ~first & ~opens & ~np.concatenate([[False], closes[:-1]])[: len(first)]
    return pc.binary_join_element_wise(pc.if_else(pa.array(apart), " ", ""), texts, "")


def joined(texts: pa.Array, starts: np.ndarray, by: str) -> pa.Array:
    """The texts of every group as one."""
    ends = pa.array(np.append(starts, len(texts)).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(ends, pc.fill_null(texts, "")), by)


def collapsed(texts: pa.Array) -> pa.Array:
    """As functions.text.collapsed."""
    return pc.utf8_trim(pc.replace_substring_regex(texts, r"[ \t\n\x0B\f\r]+", " "), " ")


def emphasis(texts: pa.Array, bold: np.ndarray, italic: np.ndarray, mono: np.ndarray) -> pa.Array:
    """As operators.layout.emphasis, with white space at the ends of a text as one space: code, or escaped with stars for italic and bold."""
    core = pc.utf8_trim(pc.replace_substring_regex(texts, r"[ \t\n\x0B\f\r]+([\x{85}\x{2028}\x{2029}])\z", r"\1"), _SPACE)
    none = pc.equal(core, "")
    of = np.where(none.to_numpy(zero_copy_only=False), 0, np.where(mono, 4, bold * 2 + italic * 1))
    mark = pa.array(["", "*", "**", "***", "`"]).take(pa.array(of))
    inner = pc.if_else(pa.array(mono), pc.replace_substring(core, "`", ""), pc.replace_substring_regex(core, r"([\\`*_\[\]#|<>])", r"\\\1"))
    lead, tail = (pc.if_else(pc.match_substring_regex(texts, p), " ", "") for p in (_OPENS, _CLOSES))
    return pc.binary_join_element_wise(lead, mark, inner, mark, tail, "")


def listed(groups: np.ndarray, n: int, columns: dict[str, np.ndarray | pa.Array], kinds: dict[str, pa.DataType]) -> pa.Array:
    """Rows, sorted by the number of their group, as lists of structs: one list for each of ``n`` groups."""
    arrays = [columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], kind) for c, kind in kinds.items()]
    ends = np.searchsorted(groups, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(arrays, list(kinds)))
