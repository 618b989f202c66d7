"""License detection by ordered signature rules."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lamina.llm.license_rules import rules
from lamina.llm.shared import as_frame, cached, prepare, texts_of, tidied

ID = re.compile(r"[\w+-]+(?:\.[\w+-]+)*")
#: (, ids joined by OR, AND and WITH, )
EXPRESSION = re.compile(rf"spdx-license-identifier:[ \t]*([( \t]*{ID.pattern}(?:[) \t]*[ \t)](?:or|and|with)[ \t(][( \t]*{ID.pattern})*)", re.IGNORECASE)


class Scanner:
    """Rules gated by their keywords, found together by one automaton."""

    def __init__(self, table=None):
        import ahocorasick

        self.rules = rules() if table is None else table
        self.patterns = [re.compile(r"(?<!\w)(?:" + p.replace(" ", r"\s+").replace(r"\s+?", r"\s*") + ")", re.IGNORECASE | re.DOTALL) for *_, p in self.rules]
        # ids of SPDX expressions, by the rules of the tag
        self.ids: dict[str, int] = {}
        for n, (name, kind, *_) in enumerate(self.rules):
            if kind == "tag":
                low = name.lower()
                for x in (low, low.removesuffix("-or-later") + "+" if low.endswith("-or-later") else low + "-only"):
                    self.ids.setdefault(x, n)
        by_phrase: dict[str, list[int]] = {}
        for n, (_, _, _, phrases, _) in enumerate(self.rules):
            for w in phrases:
                by_phrase.setdefault(w, []).append(n)
        self.auto = ahocorasick.Automaton()
        for w, own in by_phrase.items():
            self.auto.add_word(w, (len(w), tuple(own)))
        self.auto.make_automaton()
        #: for whole batches: one pattern of all keywords at word starts, any white space between their words
        self.gate = "(?i)" + "|".join((r"\b" if w[0].isalnum() else "") + r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+".join(map(re.escape, w.split())) for w in sorted(by_phrase))

    def gated(self, text: str) -> list[int]:
        """Rules of which a whole keyword occurs at the start of a word, with any white space within."""
        hit: set[int] = set()
        low = " ".join(text.lower().split())
        for end, (size, own) in self.auto.iter(low):
            at = end - size
            if at < 0 or not (low[at] == "_" or low[at].isalnum()) or not low[at + 1].isalnum():
                hit.update(own)
        return sorted(hit)

    def scan(self, text: str, gate: bool = True) -> list[tuple[int, int, int]]:
        """(begin, end, rule) of the detections that stand, by place."""
        found = [(m.start(), m.end(), n) for n in (self.gated(text) if gate else range(len(self.rules))) for m in self.patterns[n].finditer(text)]
        return self.resolve(found + self.expressions(text))

    def expressions(self, text: str) -> list[tuple[int, int, int]]:
        """Every known id of each SPDX expression, at its own place: those after the first or in brackets too."""
        return [(t.start(), t.end(), self.ids[t[0].lower()]) for m in EXPRESSION.finditer(text) for t in ID.finditer(text, m.start(1), m.end(1)) if t[0].lower() in self.ids]

    def resolve(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Highest priority first, then the longer, then the earlier rule; a detection falls if a
        standing one contains it, as it is a part of that; those that overlap in part all stand."""
        order = sorted(set(found), key=lambda d: (-self.rules[d[2]][2], d[0] - d[1], d[2], d[0]))
        stand: list[tuple[int, int, int]] = []
        # standing intervals that no other contains: both ends rise
        begins: list[int] = []
        ends: list[int] = []
        for d in order:
            lo, hi, _ = d
            at = bisect_right(begins, lo)
            if at and ends[at - 1] >= hi:
                continue
            stand.append(d)
            first, last = bisect_left(begins, lo), bisect_right(ends, hi)
            begins[first : max(first, last)] = [lo]
            ends[first : max(first, last)] = [hi]
        return sorted(stand)


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, kind, rule, begin, end), one row a detection, over whole texts.

    Texts without any keyword never leave Arrow; the others meet only the rules whose keyword they
    hold.  ``begin`` and ``end`` count characters.  Null and empty texts have no detection; equal
    rows are detected apart; null ids are kept; other columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = cached("licenses", Scanner)
        for b in batches:
            col = texts_of(b)
            at = pc.indices_nonzero(pc.match_substring_regex(col, s.gate))
            rows = []
            for i, t in zip(b.column(0).take(at).to_pylist(), col.take(at).to_pylist()):
                rows += [(i, *s.rules[n][:2], n, lo, hi) for lo, hi, n in s.scan(t)]
            cols = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "license", "kind", "rule", "begin", "end"])

    return as_frame(docs, id_col, text_col).mapInArrow(tidied(run), "doc_id bigint, license string, kind string, rule int, begin int, end int")
