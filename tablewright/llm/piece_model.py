"""Vocabulary of a SentencePiece BPE model with byte fallback, and the split of texts into keys.

No piece holds a space mark after another character, so no merge crosses from a
word to the next space: a text falls into spans of spaces followed by a word, and
equal spans always get equal tokens.  Where no piece goes on with a line break, a
span also ends before one.  A span is named by its key: the word alone when exactly
one space precedes it, the whole span otherwise.

Merges among spaces alone rank last and go from left to right up to the longest
piece of spaces; a long run therefore starts with whole pieces of that length,
which are cut off as keys of their own.
"""

from __future__ import annotations

import functools
import re

from sentencepiece import sentencepiece_model_pb2 as proto

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

_SPANS = re.compile(" +[^ ]*")
_SPANS_AND_LINES = re.compile(r" +[^ \n]*|\n[^ \n]*")


class PieceModel:
    """Pieces, ranks (0 is merged first, equal scores share a rank) and byte ids of a model file."""

    def __init__(self, path: str):
        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = [p.type for p in model.pieces]
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
            raise ValueError(f"{path}: only BPE models with byte fallback are supported")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError(f"{path}: only plain normalisation with a leading space is supported")
        if set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path}: user-defined pieces are not supported")
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = kinds
        self.unk_id, self.end_id = model.trainer_spec.unk_id, model.trainer_spec.eos_id
        self.unk_surface = model.trainer_spec.unk_surface
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(SPACE in piece.lstrip(SPACE) for piece in self.ids):
            raise ValueError(f"{path}: pieces may hold spaces only at their start")
        order = {s: i for i, s in enumerate(sorted({model.pieces[i].score for i in self.ids.values()}, reverse=True))}
        self.ranks = {piece: order[model.pieces[i].score] for piece, i in self.ids.items()}
        self.byte_ids = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
        self.characters = {piece for piece in self.ids if len(piece) == 1}
        #: Length of the pieces that a long run of spaces starts with, 0 if runs may not be cut.
        self.space_run = self._space_run()
        #: No piece goes on with a line break, so a span may end before one.
        self.line_ends = not any("\n" in piece[1:] for piece in self.ids)

    def _space_run(self) -> int:
        sizes = {len(p) for p in self.ids if len(p) > 1 and not p.strip(SPACE)}
        if not sizes or {self.ranks[SPACE * n] for n in sizes} != {max(self.ranks.values())}:
            return 0
        if any(p.startswith(SPACE * 2) and p.strip(SPACE) for p in self.ids):
            return 0
        longest = max(sizes)
        for run in range(2 * longest, 3 * longest + 1):
            parts, at = [1] * run, 0
            while at < len(parts) - 1:  # the leftmost pair that forms a piece, again and again
                if parts[at] + parts[at + 1] in sizes:
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                    at = 0
                else:
                    at += 1
            if parts[0] != longest:
                return 0
        return longest

    def keys(self, text: str) -> list[str]:
        """Keys of the spans of a text, in order; none for an empty text."""
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if self.line_ends and "\n" in text:
            if "  " not in text and " \n" not in text and text[0] not in " \n":
                return text.replace("\n", " \n").split(" ")
        elif "  " not in text and text[0] != " ":
            return text.split(" ")
        found = []
        for span in (_SPANS_AND_LINES if self.line_ends else _SPANS).findall(" " + text):
            if span[1:2] != " ":
                found.append(span if span[0] == "\n" else span[1:])
                continue
            spaces = len(span) - len(span.lstrip(" "))
            whole = (spaces - 1) // self.space_run if self.space_run else 0
            if whole > 1:
                found += [" " * self.space_run] * (whole - 1)
                span = span[(whole - 1) * self.space_run :]
            found.append(span)
        return found

    def symbols(self, key: str) -> str:
        """The span that a key stands for, spaces as the model writes them."""
        if key[:1] == " ":
            return key.replace(" ", SPACE)
        return key if self.line_ends and key[:1] == "\n" else SPACE + key


@functools.lru_cache(maxsize=4)
def load(path: str) -> PieceModel:
    return PieceModel(path)
