"""Token ids of a public byte-level BPE, as little-endian unsigned 32-bit bytes."""

from __future__ import annotations

import base64
import re
import struct
from array import array
from sys import byteorder

#: A character outside those on which all regular-expression engines agree about letters, digits and white space, or a run of white space.
_OTHER = re.compile(r"[^\x20-\x7e\n\u00a1-\u00ac\u00ae-\u024f\u2013-\u2026\u20ac]|[ \n][ \n]")
#: The vocabulary's pre-tokeniser without its rule about runs of white space, which has no effect where there are none.
_NO_RUNS = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """encode(text): what the tokenizers file gives without special tokens added.

    Texts of ordinary characters without runs of white space go through the rank file of the same vocabulary, whose
    simpler pre-tokeniser needs no look-ahead; all others go to the tokenizers file.
    """

    def __init__(self, tokenizer_file: str, rank_file: str):
        import tiktoken
        from tokenizers import Tokenizer

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(rank_file, "rb"))}
        self._ranked = tiktoken.Encoding("ranked", pat_str=_NO_RUNS, mergeable_ranks=ranks, special_tokens={})
        self._whole = Tokenizer.from_file(tokenizer_file)
        self._added = [str(t.content) for t in self._whole.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> bytes:
        if _OTHER.search(text) or any(a in text for a in self._added):
            ids = self._whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self._ranked.encode_ordinary(text)
        return array("I", ids).tobytes() if byteorder == "little" else struct.pack(f"<{len(ids)}I", *ids)


_loaded: dict[tuple[str, str], Encoder] = {}


def encoder(tokenizer_file: str, rank_file: str) -> Encoder:
    """The worker's encoder of these files, loaded once."""
    key = (tokenizer_file, rank_file)
    if key not in _loaded:
        _loaded[key] = Encoder(tokenizer_file, rank_file)
    return _loaded[key]
