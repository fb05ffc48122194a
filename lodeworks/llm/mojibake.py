"""Text decoded with the wrong character encoding: find it and restore what can be restored.

Characters are mapped back to the bytes they stand for in a legacy code page, and an
automaton of the byte structure finds the maximal spans of well-formed multibyte sequences.
Only those spans are decoded, and only where

* the span is evident, that is, no writing has it: a symbol between letters, a capital
  beyond ASCII behind a small letter, letters of two scripts, control characters, several
  sequences in a row. Spans that ordinary writing can have (a capital before a closing
  quote) are decoded only beside evident ones;
* the words it then belongs to are written in one script, in assigned characters.

This holds for UTF-8 misread as any single-byte page and is repeated until nothing changes,
for texts that were garbled more than once; every round shortens the text. The same is done
for the double-byte pages of East Asian scripts. Two further kinds leave no such spans:
replacement characters, which can't be undone, and single-byte text read with another
single-byte page, which shows as words of the same evident kinds and is undone word by word.
All tests go by Unicode's scripts and categories; there is no list of letters or words.

Scale: map-only over Arrow batches, for texts in which the JVM finds a character beyond ASCII.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, kind string, codecs string, spans int, lost int, restored string"
_OUT = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("codecs", pa.string()), ("spans", pa.int32()), ("lost", pa.int32()), ("restored", pa.string())])

#: Code pages that UTF-8 bytes are commonly misread with. latin_1 comes with cp1252, whose
#: unused bytes (and C1 controls in general) stand for themselves.
MISREAD_UTF8 = ("cp1252", "cp1250", "cp1251", "cp437", "cp850", "cp852", "cp866", "mac_roman", "cp1253", "cp1254", "iso8859_2", "iso8859_15", "koi8_r", "cp1257")
#: (true, misread as) pairs of single-byte code pages.
SINGLE_BYTE = tuple(
    (true, wrong)
    for true, wrongs in (
        ("cp1252", ("mac_roman", "cp1251", "cp437", "cp850", "cp1250", "cp1253", "koi8_r", "cp866")),
        ("cp1250", ("cp1252", "cp1251", "cp852", "mac_roman", "cp437")),
        ("iso8859_2", ("cp1252", "cp1250", "cp1251")),
        ("cp1251", ("cp1252", "koi8_r", "mac_roman", "cp1250", "cp1253", "cp866", "cp437")),
        ("koi8_r", ("cp1252", "cp1251", "iso8859_15", "cp1250", "cp866", "mac_roman")),
        ("cp866", ("cp1252", "cp1251", "cp437", "koi8_r")),
        ("cp1253", ("cp1252", "cp1251", "mac_roman", "cp437")),
        ("mac_roman", ("cp1252", "cp1251", "cp437")),
        ("cp437", ("cp1252",)),
        ("cp850", ("cp1252",)),
    )
    for wrong in wrongs
)
@lru_cache(maxsize=None)
def _page(codec: str) -> dict[str, int]:
    """High characters of a code page by byte; its undefined bytes, for cp1252 all C1 controls, by number."""
    out = {chr(b): b for b in range(0x80, 0xA0)} if codec == "cp1252" else {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


#: Double-byte pages: bytes of a character, and the lead bytes of their everyday characters (kana, hangul, first-level ideographs).
DOUBLE_BYTE = (
    ("shift_jis", "[\x81-\x9f\xe0-\xef][\x40-\x7e\x80-\xfc]|[\xa1-\xdf]", ((0x82, 0x83), (0x88, 0x98))),
    ("euc_jp", "[\xa1-\xfe][\xa1-\xfe]|\x8e[\xa1-\xdf]", ((0xA4, 0xA5), (0xB0, 0xCF))),
    ("gbk", "[\x81-\xfe][\x40-\x7e\x80-\xfe]", ((0xB0, 0xD7),)),
    ("big5", "[\xa1-\xf9][\x40-\x7e\xa1-\xfe]", ((0xA4, 0xC6),)),
    ("euc_kr", "[\xa1-\xfe][\xa1-\xfe]", ((0xB0, 0xC8),)),
)


@lru_cache(maxsize=65_536)
def _script(char: str) -> str | None:
    """Script of a letter, mark or digit by its Unicode name, the scripts written together in East Asia as one; None for what any script uses."""
    if not char.isalpha() and unicodedata.category(char) not in ("Mn", "Mc", "Nd"):
        return None
    first = unicodedata.name(char, "?").split()[0]
    if first in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "BOPOMOFO", "IDEOGRAPHIC", "FULLWIDTH", "HALFWIDTH", "KATAKANA-HIRAGANA"):
        return "EAST"
    return None if first in ("MODIFIER", "FEMININE", "MASCULINE", "MICRO", "COMBINING", "VARIATION", "DIGIT") else first


@lru_cache(maxsize=65_536)
def _joins(char: str) -> bool:
    """Whether writing puts this between letters: marks, apostrophes, dashes, format characters, digits, ASCII."""
    return char.isascii() or unicodedata.category(char) in ("Mn", "Mc", "Pd", "Cf", "Nd", "Zs", "Lm") or char in "·‧\u2018\u2019"


@lru_cache(maxsize=65_536)
def _assigned(char: str) -> bool:
    return unicodedata.category(char) not in ("Cn", "Co", "Cs")


def odd(word: str) -> bool:
    """Whether no writing has this: see the module's list of evident kinds.

    ``word`` has no white space of its own; signs at its ends (of units, trade marks,
    ordinals) are no such kind.
    """
    if word.isascii():
        return False
    return _odd_short(word) if len(word) <= 40 else _odd(word)


def _odd(word: str) -> bool:
    scripts: set[str] = set()
    before, gap = None, False  # the last letter, and whether signs that don't join stand behind it
    for c in word:
        script = _script(c)
        if script is None:
            if "\x80" <= c <= "\x9f":
                return True
            if c == "\ufffd" or _joins(c):
                before, gap = None, False
            else:
                gap = before is not None
            continue
        if gap and script != "EAST":
            return True
        scripts.add(script)
        if before is not None and not c.isascii() and c.isupper() and before.islower() and _script(before) == script:
            return True
        before = c
    return len(scripts) > 1


_odd_short = lru_cache(maxsize=100_000)(_odd)


def foreign(word: str) -> bool:
    """Three Latin letters or more without an ASCII one; only texts full of such words are no writing."""
    letters = [c for c in word if _script(c) is not None]
    return len(letters) > 2 and all(not c.isascii() and _script(c) == "LATIN" for c in letters)


def _around(text: str, start: int, end: int) -> tuple[str, str]:
    """What stands before and behind a span without white space between."""
    a, b = start, end
    while a > 0 and not text[a - 1].isspace():
        a -= 1
    while b < len(text) and not text[b].isspace():
        b += 1
    return text[a:start], text[end:b]


def _one_script(word: str) -> bool:
    return len({s for c in word if (s := _script(c)) is not None}) <= 1


class _Automaton:
    """Maximal runs of well-formed UTF-8 multibyte sequences, over misread characters."""

    def __init__(self, codec: str) -> None:
        self.codec = codec
        self.page = _page(codec)

        def cls(lo: int, hi: int) -> str:
            return "[" + "".join(re.escape(c) for c, b in self.page.items() if lo <= b <= hi) + "]"

        self.leads = frozenset(c for c, b in self.page.items() if 0xC2 <= b <= 0xF4)
        self.tails = frozenset(c for c, b in self.page.items() if b <= 0xBF)
        tail = cls(0x80, 0xBF)
        self.pattern = re.compile(f"(?:{cls(0xC2, 0xDF)}{tail}|{cls(0xE0, 0xEF)}{tail}{{2}}|{cls(0xF0, 0xF4)}{tail}{{3}})+")

    def decode(self, span: str) -> str | None:
        try:
            return bytes(self.page[c] for c in span).decode("utf-8")
        except (UnicodeDecodeError, KeyError):
            return None


_AUTOMATA: list[_Automaton] = []


def _automata() -> list[_Automaton]:
    if not _AUTOMATA:
        _AUTOMATA.extend(_Automaton(c) for c in MISREAD_UTF8)
    return _AUTOMATA


def _evident(span: str, decoded: str, left: str, right: str) -> bool:
    """Whether a span can't just as well be ordinary writing where it stands."""
    if any("\x80" <= c <= "\x9f" for c in span):
        return True
    if len(span) > 2 and len(decoded) == 1 and (0x2000 <= ord(decoded) < 0x2200 or decoded in "\ufeff\ufffd") and any(_script(c) is None for c in span):
        return True
    if len(decoded) > 1:
        nonletters = sum(_script(c) is None and not c.isspace() for c in span)
        turns = sum(a.islower() and b.isupper() for a, b in zip(span, span[1:]))
        if nonletters > 1 or turns or not _one_script(span):
            return True
    if all(_script(c) is None for c in span) and (_script(left[-1:] or " ") or _script(right[:1] or " ")) == _script(decoded[0]) is not None:
        return True  # signs where a letter of the word has to stand
    near = left[-1:] + span + right[:1]
    if odd(near):
        return True
    # Letters of two scripts in the word, of which the decoded one has a single one.
    return not _one_script(left + span + right)


def _spans(automaton: _Automaton, text: str) -> tuple[list[tuple[int, int, str, bool]], int]:
    """(start, end, decoded, evident) of the spans that may be decoded, and how many are evident."""
    out, sure = [], 0
    for m in automaton.pattern.finditer(text):
        span, decoded = m.group(), automaton.decode(m.group())
        if decoded is None or not all(map(_assigned, decoded)):
            continue
        left, right = _around(text, *m.span())
        if not _one_script(decoded):
            continue
        evident = _evident(span, decoded, left, right)
        # The word around may itself be garbled elsewhere; only its plain letters have to agree.
        beside = "".join(c for c in left + right if c.isascii() or c not in automaton.page)
        if not _one_script(decoded + beside):
            continue
        sure += evident
        out.append((m.start(), m.end(), decoded, evident))
    return out, sure


def _one_round(text: str) -> tuple[str, str, int] | None:
    """(decoded text, codec, spans) of the code page that explains most, if any does."""
    best = None
    present = frozenset(text)
    for automaton in _automata():
        if present.isdisjoint(automaton.leads) or present.isdisjoint(automaton.tails) or not automaton.pattern.search(text):
            continue
        spans, sure = _spans(automaton, text)
        if not sure:
            continue
        # What reads as running text counts twice: pages differ in little but what they make of a few bytes.
        weight = sum((b - a) * (2 if all(map(_usual, decoded)) else 1) for a, b, decoded, evident in spans if evident), sum(b - a for a, b, *_ in spans)
        if best is None or weight > best[0]:
            best = (weight, automaton.codec, spans, sure)
    if best is None:
        return None
    out, at, done = [], 0, 0
    # Where most spans are ordinary writing, only the evident ones aren't.
    mostly = 2 * best[3] >= len(best[2])
    # Blocks of 256 characters that the evident ones come from, Latin-1, and general punctuation and signs.
    blocks = {0, 0x20, 0x21} | {ord(c) >> 8 for _, _, decoded, evident in best[2] if evident for c in decoded}
    for a, b, decoded, evident in best[2]:
        if not evident and (not mostly or any(ord(c) >> 8 not in blocks for c in decoded)):
            continue
        left, right = _around(text, a, b)
        # A capital with quotes behind it, at the end of a word in capitals: ordinary writing.
        if not evident and best[3] < 3 and left[-1:].isupper() and not right[:1].isalpha():
            continue
        out += [text[at:a], decoded]
        at = b
        done += 1
    return "".join(out) + text[at:], best[1], done


#: Three characters of the Western page in a row, which every such text has.
_HIGH_RUN = re.compile("[" + "".join(map(re.escape, _page("cp1252"))) + "]{3}")


def _double_byte(text: str) -> tuple[str, str, int] | None:
    """(decoded text, codecs, runs) of East Asian double-byte text read as a Western page.

    Such a text shows as runs of characters beyond ASCII; a page explains it if nearly all
    of them stand in runs of at least two characters it decodes, and nine tenths of those
    are everyday characters; Japanese has kana among them. Of several pages the one with the
    fewest everyday characters explains most.
    """
    page = _page("cp1252")
    if not _HIGH_RUN.search(text):
        return None
    high = sum(c in page for c in text)
    if high < 6 or 2 * high < sum(not c.isascii() for c in text):
        return None
    raw = "".join(chr(page[c]) if c in page else c if c.isascii() else "\x00" for c in text)
    best = None
    for codec, char, everyday in DOUBLE_BYTE:
        out, at, runs, covered, chars, usual, kana = [], 0, 0, 0, 0, 0, 0
        for m in re.finditer(f"(?:{char}){{2,}}", raw):
            try:
                decoded = m.group().encode("latin_1").decode(codec)
            except UnicodeDecodeError:
                continue
            if decoded.isascii() or not _one_script(decoded):
                continue
            bytes_of = [x.encode(codec)[0] for x in decoded]
            chars += len(decoded)
            usual += sum(any(lo <= b <= hi for lo, hi in everyday) or unicodedata.category(x)[0] in "PZ" for x, b in zip(decoded, bytes_of))
            kana += sum("\u3040" <= x <= "\u30ff" for x in decoded)
            covered += sum(c >= "\x80" for c in m.group())
            out += [text[at : m.start()], decoded]
            at = m.end()
            runs += 1
        breadth = sum(hi - lo + 1 for lo, hi in everyday)
        if runs and 10 * covered >= 9 * high and 10 * usual >= 9 * chars and (codec[-2:] not in ("is", "jp") or 5 * kana >= chars) and (best is None or breadth < best[0]):
            best = (breadth, "".join(out) + text[at:], codec, runs)
    return (best[1], f"{best[2]}<cp1252", best[3]) if best else None


_TOKEN = re.compile(r"\S*[^\x00-\x7f\s]\S*")
_PAGES: dict[tuple[str, str], dict[int, str]] = {}


def _remap(true: str, wrong: str) -> dict[int, str]:
    """Translation of characters misread as ``wrong`` into those of ``true``."""
    if (true, wrong) not in _PAGES:
        table = {}
        for char, byte in _page(wrong).items():
            try:
                table[ord(char)] = bytes([byte]).decode(true)
            except UnicodeDecodeError:
                continue
        _PAGES[true, wrong] = table
    return _PAGES[true, wrong]


@lru_cache(maxsize=65_536)
def _usual(char: str) -> bool:
    """Small letters of the first block of their script, and the punctuation of running text: what texts have most of."""
    o = ord(char)
    return (char.islower() and (0xDF <= o <= 0xFF or 0x3AC <= o <= 0x3CE or 0x430 <= o <= 0x44F)) or 0x2013 <= o <= 0x2026


_PLAIN_ENDS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def _ends(word: str) -> tuple[str, str] | None:
    """First and last letter of a word that has no others beyond ASCII."""
    core = word.strip(_PLAIN_ENDS)
    if len(core) < 4 or core[0].isascii() or core[-1].isascii() or not (core[0].isalpha() and core[-1].isalpha() and core[1:-1].isascii()):
        return None
    return core[0], core[-1]


def _quotes(ends: tuple[str, str] | None, table: dict[int, str]) -> bool:
    """Whether a page makes an opening and a closing quote of the letters a word begins and ends with."""
    if ends is None or not ((first := table.get(ord(ends[0]))) and (last := table.get(ord(ends[1])))):
        return False
    return (unicodedata.category(first), unicodedata.category(last)) in (("Pi", "Pf"), ("Ps", "Pe"), ("Ps", "Pi"))


def _by_word(text: str) -> tuple[str, str, int] | None:
    """(restored text, codecs, words) if some pair of code pages makes most of the odd words writable."""
    tokens = _TOKEN.findall(text)
    words = [w for w in tokens if odd(w)]
    strange = [w for w in tokens if not odd(w) and foreign(w)]
    if strange and 2 * (len(strange) + len(words)) > sum(any(map(str.isalpha, w)) for w in text.split()):
        words += strange
    held = [x for w in tokens if (x := _ends(w)) and not odd(w)]
    if not words and not held:
        return None
    best = None
    for true, wrong in SINGLE_BYTE:
        table = _remap(true, wrong)
        quoted = sum(_quotes(x, table) for x in held)
        mended, usual = quoted, 2 * quoted
        for old in words:
            new = old.translate(table)
            if new != old and not odd(new) and not any("\x80" <= c <= "\x9f" for c in new):
                mended += 1
                usual += sum(_usual(c) for c in new) - sum(not c.isascii() and not _usual(c) for c in new)
        if 2 * mended > len(words) + quoted and usual > 0 and (best is None or (mended, usual) > best[:2]):
            best = (mended, usual, true, wrong, table)
    if best is None:
        return None
    count, _, true, wrong, table = best

    def gains(old: str) -> bool:
        new = old.translate(table)
        return new != old and not odd(new) and sum(map(_usual, new)) > sum(map(_usual, old))

    # If the page makes running text of nearly all words beyond ASCII, all of them were misread.
    others = [w for w in tokens if not odd(w)]
    whole = count > 1 and 5 * sum(map(gains, others)) >= 4 * len(others)

    def fix(m: re.Match) -> str:
        old = m.group()
        return old.translate(table) if odd(old) or _quotes(_ends(old), table) or (whole and gains(old)) or (count > 2 and not odd(old.translate(table))) else old

    return _TOKEN.sub(fix, text), f"{true}<{wrong}", count


def restore(text: str | None) -> tuple[str, str, int, int, str] | None:
    """(kind, codecs, spans, lost, restored) of a garbled text, None for any other.

    kind: ``utf8`` (UTF-8 misread, decoded back), ``double_byte`` and ``single_byte``
    (misread between code pages), ``lost`` (only replacement characters are left); ``lost``
    counts replacement characters that remain. Null, empty and ASCII texts are never garbled.
    """
    if not text or text.isascii():
        return None
    current, codecs, spans = text, [], 0
    while (step := _one_round(current)) is not None and step[0] != current:
        current, codec, n = step
        codecs.append(codec)
        spans += n
    kind = "utf8" if codecs else None
    left = sum(map(odd, _TOKEN.findall(current)))
    if left:
        # Where a page mends more odd words than the spans did, those came about by chance.
        mended = sum(map(odd, _TOKEN.findall(text))) - left
        if kind is None or left > mended or spans < 3:
            for other, repair in (("double_byte", _double_byte), ("single_byte", _by_word)):
                if (whole := repair(text)) and (kind is None or whole[2] > mended):
                    current, codec, spans = whole
                    codecs, kind = [codec], other
                    break
    elif kind is None:
        for other, repair in (("double_byte", _double_byte), ("single_byte", _by_word)):
            if whole := repair(text):
                current, codec, spans = whole
                codecs, kind = [codec], other
                break
    lost = current.count("\ufffd")
    if kind is None and not lost:
        return None
    return kind or "lost", ",".join(codecs), spans, lost, current


def garbled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kind, codecs, spans, lost, restored of every garbled document; see ``restore``.

    Whole texts are read. Rows that repeat an id are each judged. Documents without id
    are left out; an empty table gives none.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if found := restore(value.as_py()):
                    rows.append((doc, *found))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(_OUT)], schema=_OUT)

    beyond = F.col(text).rlike(r"[^\x00-\x7f]")
    return docs.where(F.col(doc_id).isNotNull() & beyond).select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(judge, SCHEMA)
