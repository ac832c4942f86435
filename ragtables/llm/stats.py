"""Counts that describe a text, for whole batches at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

from .textkit import Words, buffers, full_windows, mix, span_hashes, windows

SYMBOLS = b"#*$%&|<>"
REPEAT = 5


def _flags(values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_SYMBOL, _DIGIT, _UPPER, _STOP = _flags(SYMBOLS), _flags(range(48, 58)), _flags(range(65, 91)), _flags(b".,;:!?")
_HEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)])


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """Per text: words, their characters, symbols, lines, repeated lines, words in repeated windows, and more."""
    data, offsets = buffers(column)
    w = Words(data, offsets)
    n = len(offsets) - 1
    doc = w.docs()
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, w.starts, 1)
    np.add.at(inside, w.ends, -1)
    inside = np.cumsum(inside[:-1]) > 0
    out = {"n_words": w.counts, "n_chars": _per_text(_HEAD[data], offsets), "word_chars": _per_text(_HEAD[data] & inside, offsets)}
    for name, table in (("n_symbols", _SYMBOL), ("n_digits", _DIGIT), ("n_upper", _UPPER), ("n_stops", _STOP)):
        out[name] = _per_text(table[data], offsets)
    # lines that have a word
    feed = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1], feed + 1]))
    begin = begin[begin < len(data)]
    owner = np.searchsorted(offsets, begin, side="right") - 1
    stop = np.minimum(np.append(begin[1:], len(data)), offsets[owner + 1])
    stop = stop - ((data[stop - 1] == 10) if len(stop) else 0)
    full = np.searchsorted(w.starts, stop) > np.searchsorted(w.starts, begin)
    begin, stop, owner = begin[full], stop[full], owner[full]
    key = mix(span_hashes(data, begin, stop) + mix(owner.astype(np.uint64)))
    first = ~pd.Series(key).duplicated().to_numpy()
    out["n_lines"] = np.bincount(owner, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(owner[first], minlength=n)
    # words under windows that occur again in their text
    hashes = w.hashes()
    starts = full_windows(w.ptr, REPEAT)
    if len(starts):
        code, _ = pd.factorize(mix(windows(hashes, REPEAT)[starts] + mix(doc[starts].astype(np.uint64))))
        again = starts[np.bincount(code)[code] > 1]
        edge = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + REPEAT, -1)
        covered = np.cumsum(edge[:-1]) > 0
    else:
        covered = np.zeros(len(hashes), bool)
    out["n_repeat_words"] = np.diff(np.concatenate([[0], np.cumsum(covered)])[w.ptr])
    new = ~pd.Series(mix(hashes + mix(doc.astype(np.uint64)))).duplicated().to_numpy()
    out["n_distinct"] = np.bincount(doc[new], minlength=n)
    return {k: v.astype(np.int64) for k, v in out.items()}


def shape(c: dict[str, np.ndarray]) -> np.ndarray:
    """A row of variance-stabilised shares per text, for the models."""
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "n_chars", "n_lines"))
    return np.stack(
        [
            np.log(words),
            np.log(np.maximum(c["word_chars"], 1) / words),
            np.sqrt(c["n_symbols"] / words),
            np.sqrt(c["n_dup_lines"] / lines),
            np.sqrt(c["n_repeat_words"] / words),
            np.log((c["n_distinct"] + 1) / (words + 1)) / np.log(words + 20),
            np.sqrt((c["n_digits"] + c["n_upper"]) / chars),
            np.sqrt(c["n_stops"] / words),
        ],
        1,
    )
