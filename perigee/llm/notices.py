"""License scan by fuzzy search of short notices.

A notice of n characters that stands in a text with at most k edits holds one of its
k + 1 parts unchanged (pigeonhole). All parts of all notices are found at once by an
Aho-Corasick automaton; around each find the regex library's bounded-error matching
verifies the notice, counts the edits and gives the span; the best match of a stretch
first, then those on either side of it.
"""

from __future__ import annotations

from functools import cached_property

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from perigee.llm.fmindex import words_of
from perigee.llm.shared import column, map_batches, rows_of, texts

# The phrases of the base and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Short notices in normal form (words, single spaces) and their labels.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under the creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("subject to the terms of the mozilla public license", "mpl"),
)
ERROR_SHARE = 0.07


class Searcher:
    """The automaton of the notices' parts and their patterns, built in the task."""

    def __init__(self, notices=NOTICES, phrases=PHRASES, error_share: float = ERROR_SHARE) -> None:
        self.notices, self.phrases = notices, phrases
        self.errors = [max(1, int(len(text) * error_share)) for text, _ in notices]

    @cached_property
    def parts(self):
        by: dict[str, list[tuple[int, int]]] = {}
        for k, (text, _) in enumerate(self.notices):
            pieces = self.errors[k] + 1
            edges = [len(text) * i // pieces for i in range(pieces + 1)]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                by.setdefault(text[start:end], []).append((k, start))
        automaton = ahocorasick.Automaton()
        for part, places in by.items():
            automaton.add_word(part, (len(part), places))
        automaton.make_automaton()
        return automaton

    @cached_property
    def patterns(self):
        return [
            regex.compile(f"(?b)(?:{regex.escape(text)}){{e<={k}}}")
            for (text, _), k in zip(self.notices, self.errors, strict=True)
        ]

    def fuzzy(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) in characters of the normal form, in order."""
        ranges: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.parts.iter(text):
            for k, offset in places:
                start, slack = end + 1 - size - offset, self.errors[k]
                low, high = max(0, start - slack), min(len(text), start + len(self.notices[k][0]) + slack)
                spans = ranges.setdefault(k, [])
                if spans and low <= spans[-1][1] and low >= spans[-1][0]:
                    spans[-1][1] = max(spans[-1][1], high)
                else:
                    spans.append([low, high])
        found = set()
        for k, spans in ranges.items():
            joined: list[list[int]] = []
            for low, high in sorted(spans):
                if joined and low <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], high)
                else:
                    joined.append([low, high])
            while joined:
                low, high = joined.pop()
                # the best match of a range may stand behind others: search on both sides of it
                if match := self.patterns[k].search(text, low, high):
                    found.add((match.start(), k, match.end(), sum(match.fuzzy_counts)))
                    joined += [[low, match.start()], [match.end(), high]]
        return [(k, start, end, edits) for start, k, end, edits in sorted(found)]

    def scan(self, text: bytes | None) -> tuple:
        words = words_of(text)
        joined = b" ".join(words)
        framed = b" " + joined + b" "
        places, base = [], set()
        for phrase, label in self.phrases:
            sought = b" " + phrase.encode() + b" "
            at = framed.find(sought)
            while at >= 0:
                places.append(framed.count(b" ", 0, at))
                base.add(label)
                at = framed.find(sought, at + 1)
        plain, spans, score = joined.decode("utf-8", "replace"), [], 1.0 if base else 0.0
        for k, start, end, edits in self.fuzzy(plain):
            notice, label = self.notices[k]
            first = plain.count(" ", 0, start + (plain[start : start + 1] == " "))
            last = plain.count(" ", 0, max(start, end - (plain[end - 1 : end] == " ")))
            spans.append({"label": label, "start": first, "end": last + 1, "edits": edits})
            score = max(score, 1 - edits / len(notice))
        labels = base | {s["label"] for s in spans}
        first, last = (min(places), max(places)) if places else (None, None)
        return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices")


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", searcher: Searcher | None = None) -> DataFrame:
    """One row per input row: id, counts and labels, and the notices found with edits.

    Words are counted from 0; `notices` has label, start and end word and edits of each
    fuzzy match, in order. `labels` joins the exact phrases' labels and the fuzzy ones;
    `score` is 1 for an exact phrase, else the best share of unedited characters, else
    0. A null text counts as empty. Matches of one notice do not overlap; of
    overlapping ones that with the fewest edits counts. Rows may
    repeat; columns other than id and text are ignored.
    """
    searcher = searcher or Searcher()
    frame = rows_of(documents, id=id_col, text=text_col)

    def work(batch: pa.RecordBatch) -> dict:
        rows = [searcher.scan(text) for text in texts(batch)]
        return {"id": column(batch, "id")} | {n: [r[k] for r in rows] for k, n in enumerate(COLUMNS)}

    schema = (
        f"id {frame.schema['id'].dataType.simpleString()}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        "base_labels string, labels string, score double, notices array<struct<label:string,start:bigint,end:bigint,edits:int>>"
    )
    return map_batches(frame, schema, work)
