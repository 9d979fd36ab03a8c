"""Quality rules, line first: each line is held against punctuation, navigation and boilerplate rules, failing lines
are removed, and a document that loses too much of its text is rejected.

Defined cases: a null or empty text has no words and no lines, fails the base rule and is not kept. Columns of the
input other than the key and the text play no part, whatever their names. Repeated rows are judged each for itself.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import SPACE, byte_hash, counted, map_text, mix, runs, seen_before, table, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Characters that separate the entries of a menu or a table.
BARS = np.zeros(256, bool)
BARS[list(b"|>")] = True
MARKS = np.zeros(256, bool)
MARKS[list(b"#*$%&<>!")] = True
UPPER, LETTERS = np.zeros(256, bool), np.zeros(256, bool)
UPPER[ord("A") : ord("Z") + 1] = True
LETTERS[ord("A") : ord("Z") + 1] = LETTERS[ord("a") : ord("z") + 1] = True
TERMINAL = np.zeros(256, bool)
TERMINAL[list(b".!?\"';:)]")] = True
#: First bytes of characters of two bytes, whose last words »-marks close as others do.
TWO_BYTES = np.arange(0xC2, 0xE0, dtype=np.uint8)
#: Phrases of licences, notices and page furniture, in the corpus's four languages: English, German, French and Spanish.
BOILERPLATE = (
    "licensed under", "released under the", "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies",
    "javascript", "lorem ipsum", "click here", "subscribe to", "sign up", "log in", "back to top", "share this", "powered by",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "verwendet cookies", "hier klicken", "nach oben", "newsletter abonnieren", "lizenziert unter",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "utilise des cookies", "cliquez ici", "haut de page", "abonnez-vous", "sous licence",
    "todos los derechos reservados", "términos de uso", "política de privacidad", "utiliza cookies", "haga clic aquí", "volver arriba", "suscríbete a", "bajo licencia",
)


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules, and how much of its text a document may lose."""

    marks_per_word: float = 0.34
    upper_share: float = 0.7
    upper_words: int = 5
    fragment_words: int = 3
    bars: int = 3
    bars_per_word: float = 0.15
    echoes_per_word: float = 0.4
    echo_words: int = 8
    max_loss: float = 0.3
    boilerplate: tuple[str, ...] = BOILERPLATE


class Lines:
    """Lines that have a word, with their words and the sums that the rules need."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off
        self.ws, self.we, self.first = words(data, off)
        self.n_words = np.diff(self.first)
        hashed = byte_hash(data)
        self.word = hashed(self.ws, self.we)
        self.word_doc = runs(self.n_words)
        cut = np.unique(np.concatenate([off[:-1], np.flatnonzero(data == 0x0A) + 1]))
        cut = cut[cut < len(data)]
        end = np.append(cut[1:], len(data)) if len(cut) else cut
        end = end - (data[end - 1] == 0x0A) if len(cut) else end
        a, b = np.searchsorted(self.ws, cut), np.searchsorted(self.ws, end)
        keep = b > a
        self.start, self.end, self.w0, self.w1 = cut[keep], end[keep], a[keep], b[keep]
        self.doc = np.searchsorted(off, self.start, side="right") - 1
        self.line = hashed(self.start, self.end)
        self.repeated, _ = seen_before(self.doc, self.line)

    def total(self, chosen: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(chosen)])
        return sums[end] - sums[start]

    def by_doc(self, chosen: np.ndarray) -> np.ndarray:
        return self.total(chosen, self.off[:-1], self.off[1:])

    def echoes(self) -> np.ndarray:
        """Words that equal the one before in the document."""
        same = np.zeros(len(self.word), bool)
        same[1:] = (self.word[1:] == self.word[:-1]) & (self.word_doc[1:] == self.word_doc[:-1])
        return same

    def repeated_words(self) -> np.ndarray:
        """By document, the words in windows of three that the document has twice or more."""
        w = self.word
        if len(w) < 3:
            return np.zeros(len(self.n_words), np.int64)
        whole = self.word_doc[2:] == self.word_doc[:-2]
        key = mix(w[:-2] + mix(w[1:-1] + mix(w[2:])))[whole]
        at = np.flatnonzero(whole)
        _, twice = seen_before(self.word_doc[at], key)
        inside = np.zeros(len(w), bool)
        for k in range(3):
            inside[at[twice] + k] = True
        return np.add.reduceat(np.append(inside, False).astype(np.int64), np.minimum(self.first[:-1], len(w))) * (self.n_words > 0)

    def repeated_lines(self) -> np.ndarray:
        return np.bincount(self.doc[self.repeated], minlength=len(self.off) - 1)


def failing_lines(lines: Lines, rules: LineRules) -> dict[str, np.ndarray]:
    """For each rule, which lines fail it."""
    d, n = lines.data, lines.w1 - lines.w0
    per = lambda chosen: lines.total(chosen, lines.start, lines.end)
    end = lines.we[lines.w1 - 1] - 1
    letters = per(LETTERS[d])
    shouting = (per(UPPER[d]) > rules.upper_share * letters) & (n >= rules.upper_words)
    marked = per(MARKS[d]) > rules.marks_per_word * n
    # characters of two bytes are letters and marks of scripts that put spaces between words; longer ones often are not
    two = (d[end] >= 0x80) & np.isin(d[np.maximum(end - 1, 0)], TWO_BYTES)
    closing = (d[np.maximum(end - 1, 0)] == 0xC2) & (d[end] == 0xBB)
    fragment = (((d[end] < 0x80) & ~TERMINAL[d[end]]) | (two & ~closing)) & (n < rules.fragment_words)
    bars = per(BARS[d])
    echo = lines.total(lines.echoes(), lines.w0, lines.w1)
    phrase = np.zeros(len(n), bool)
    if len(n):
        found = re.compile("|".join(map(re.escape, rules.boilerplate)).encode()).finditer(d.tobytes().lower())
        at = np.fromiter((m.start() for m in found), np.int64)
        line = np.searchsorted(lines.start, at, side="right") - 1
        phrase[line[line >= 0]] = True
    return {
        "punctuation": shouting | marked | fragment,
        "navigation": (bars >= rules.bars) & (bars > rules.bars_per_word * n),
        "boilerplate": phrase | lines.repeated | ((n >= rules.echo_words) & (echo > rules.echoes_per_word * n)),
    }


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_lines long, failed_punctuation long, failed_navigation long, failed_boilerplate long, lost_share double"
)


def apply_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: LineRules | None = None) -> DataFrame:
    """One row for each row of docs: the base counts, the lines that fail each rule and the verdict.
    With clean_text() the kept lines themselves can be had."""
    rules = rules or LineRules()

    def judge(piece: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> dict:
        x = Lines(data, off)
        n = len(off) - 1
        failed = failing_lines(x, rules)
        lost = np.zeros(len(x.doc), bool)
        for y in failed.values():
            lost |= y
        repeats = x.repeated_words()
        chars = (data & 0xC0 != 0x80) & ~SPACE[data]
        size = x.total(chars, x.start, x.end)
        all_chars = np.bincount(x.doc, size, n)
        share = np.bincount(x.doc, size * lost, n) / np.maximum(all_chars, 1)
        base = (x.n_words < 50) | (100 * repeats > 50 * x.n_words)
        count = lambda chosen: np.bincount(x.doc[chosen], minlength=n).astype(np.int64)
        return {
            "doc_id": piece.column("doc_id"), "n_words": x.n_words, "word_chars": x.by_doc(chars), "n_symbols": counted(np.flatnonzero(SYMBOLS[data]), off), "n_dup_lines": count(x.repeated),
            "n_repeat_words": repeats, "base_failed": base, "kept": ~base & (share <= rules.max_loss), "n_lines": np.bincount(x.doc, minlength=n).astype(np.int64),
            **{f"failed_{k}": count(y) for k, y in failed.items()}, "lost_share": share,
        }

    return map_text(docs.selectExpr(f"`{key}` AS doc_id", f"`{text}` AS text"), judge, SCHEMA)


def clean_text(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: LineRules | None = None) -> DataFrame:
    """key and the text without the lines that fail a rule (null stays null)."""
    rules = rules or LineRules()

    def clean(piece: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> dict:
        x = Lines(data, off)
        lost = np.zeros(len(x.doc), bool)
        for y in failing_lines(x, rules).values():
            lost |= y
        raw, out = data.tobytes(), []
        first = np.searchsorted(x.doc, np.arange(len(off)))
        for i, known in enumerate(piece.column("text").is_valid()):
            a, b = first[i], first[i + 1]
            kept = b"\n".join(raw[s:e] for s, e, bad in zip(x.start[a:b], x.end[a:b], lost[a:b], strict=True) if not bad)
            out.append(kept.decode() if known.as_py() else None)
        return {"doc_id": piece.column("doc_id"), "text": pa.array(out, pa.string())}

    return map_text(docs.selectExpr(f"`{key}` AS doc_id", f"`{text}` AS text"), clean, "doc_id long, text string")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"))
