"""Byte-level BPE files: bytes of their tokens, and the same merges by rank for words."""

from __future__ import annotations

import json

import numpy as np

# The pre-tokenizer of byte-level files and its pattern.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longest word that is merged by rank, and words encoded as one text.
LONG, TOGETHER = 100, 200


def byte_characters() -> dict[str, int]:
    """Characters of byte-level entries: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def token_bytes(tokenizer) -> list[bytes]:
    """Bytes of every id; entries that are no byte-level text (special tokens) stand for themselves."""
    of, entries = byte_characters(), {i: entry for entry, i in tokenizer.get_vocab().items()}
    return [bytes(of[c] for c in entries[i]) if i in entries and all(c in of for c in entries[i]) else entries.get(i, "").encode() for i in range(max(entries) + 1)]


def by_rank(tokenizer, tokens: list[bytes]):
    """The tokenizer as merges by rank: far faster, and equal where ids follow the order of the merges; else None."""
    import tiktoken

    made, ids = json.loads(tokenizer.to_str()), tokenizer.get_vocab()
    model = made["model"]
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges", [])]
    if made["normalizer"] or model["type"] != "BPE" or made["pre_tokenizer"] != BYTE_LEVEL or model.get("ignore_merges") or any(ids.get(m) != 256 + k for k, m in enumerate(merges)):
        return None
    return tiktoken.Encoding("words", pat_str=WORD_PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens[: 256 + len(merges)])}, special_tokens={})


def cut(ids: list[int], tokens: list[bytes], sizes: np.ndarray, raw: bytes, stops: np.ndarray) -> list[bytes] | None:
    """Ids (little-endian unsigned 32 bits) between the stops, without those up to the first; None if bytes are not kept or a token crosses a stop."""
    if b"".join([tokens[i] for i in ids]) != raw:
        return None
    ids = np.array(ids, dtype="<u4")
    ends = sizes[ids].cumsum()
    at = np.searchsorted(ends, stops)
    if (ends[at] != stops).any():
        return None
    held, at = ids.tobytes(), ((at + 1) * 4).tolist()
    return [held[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
