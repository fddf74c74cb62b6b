"""Sentence ends in scanned pages of many scripts.

The standard sentence-break rules run over each block of a page, by the property classes of Unicode
(ATerm, STerm, Close, Sp, SContinue, Lower, Upper, OLetter, Numeric), so terminators of all scripts
count. Tailored to them: abbreviations by the language of the block, quotations that are followed by
who said them, and what a scanner does (marks set off, misread or lost).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame

from wayspan.llm.layout import BODY, blocks, lines_of, plain_blocks

# Fixed values, by language. TITLES: abbreviations that belong to the name or clause after them.
# COUNTED: such as stand before a number. CLOSING: such as may close a sentence.
TITLES = {
    "en": "mr mrs ms messrs mme dr prof rev hon gen col capt lieut lt sgt maj supt gov sen st mt ft viz vs approx ca cf per e.g i.e",
    "de": "ca z.b d.h d.i bzw hr hrn fr frl dr prof st vgl evtl sog geb gest inkl zzgl",
    "fr": "m mm mme mlle mlles mgr dr st ste art env av ex p.ex c.-à-d bd boul prof",
    "es": "sr sra srta sres dr dra da sto sta aprox avda ej p.ej prof gral cap ca",
    "ru": "г-н г-жа ул им проф ок гл акад ср см тов просп",
    "el": "κ κα οδ δρ αγ π.χ βλ",
    "hi": "डॉ श्री कि.मी रु",
    "ar": "د أ",
}
COUNTED = {
    "en": "no nos vol vols p pp ch chap fig figs sec tel jan feb mar apr jun jul aug sept sep oct nov dec",
    "de": "nr no s bd kap abb art abs str fernspr tel",
    "fr": "n no nos p pp t vol chap fig tél",
    "es": "p pág págs núm no n vol c cap fig tel",
    "ru": "стр тел no ст п рис",
    "el": "αρ σελ τηλ no",
    "hi": "सं पृ",
    "ar": "ص ب م ت",
}
CLOSING = {
    "en": "etc a.m p.m co esq jr sr inc ltd bros doz lb lbs oz yd yds min hr hrs",
    "de": "usw etc chr v.chr n.chr pf mk uhr",
    "fr": "etc cie fr j.-c",
    "es": "etc cía pts ptas a.m p.m",
    "ru": "др пр руб коп т.д т.п н.э",
    "el": "κ.λπ κ.ά κ.τ.λ δρχ μ.μ π.μ",
}
# Function words. They tell a language of Latin script (those of two count for both), and are taken
# for a sentence's first word where they stand in capitals and the mark before them is misread or lost.
FUNCTION = {
    "en": "the a an and of to in on at is are was were be with for her his its their our my your that this these those which by from not it he she they we you i one every some each any no but or if when while as there then so however after before",
    "de": "der die das den dem des ein eine einen einem einer eines und ist war nicht mit von zu auf für im am jeder jede jedes kein keine unser unsere mein meine sein seine ihr ihre dieser diese dieses aus gegen durch er sie es wir ich wurde bei wenn als aber doch da dann hier in nach vor",
    "fr": "le la les des un une et est dans pour que qui du au il elle ils elles on nous vous je sur pas avec ce cet cette ces notre nos votre leur était chaque sous mais ou si quand comme puis alors en à après avant",
    "es": "el la los las un una unos unas y es en por que con del al se su sus este esta estos estas ese esa nuestro nuestra fue cada para pero o si cuando como entonces yo no lo después antes",
    "ru": "этот эта это эти тот та то те каждый каждая каждое один одна одно наш наша наше мой его её их он она оно они мы вы я в на и но а если когда как после перед не",
    "el": "ο η το οι τα του της των ένας μία μια ένα κάθε αυτός αυτή αυτό και να θα δεν σε με για από που αν όταν αλλά",
}
# Verbs of saying: a quotation that closes with a mark and is followed by one of them goes on with who
# said it. In scripts with case small letters tell that already; Japanese marks it with a particle.
SAYING = {
    "zh": "说 說 道 问 問 答 喊 叫 嚷 讲 講",
    "ar": "قال قالت قالوا سأل سألت أجاب أجابت رد ردت صاح صاحت هتف صرخ همس أضاف أضافت تابع گفت پرسید",
    "he": "אמר אמרה אמרו שאל שאלה ענה ענתה השיב השיבה קרא קראה לחש",
    "hi": "कहा कही बोला बोली बोले पूछा पूछी चिल्लाया चिल्लाई उत्तर जवाब বলল বললেন বলেন শুধাল",
    "am": "አለ አለች አሉ ጠየቀ ጠየቀች ጠየቁ መለሰ መለሰች ተናገረ ተናገረች ጮኸ",
}
# German ordinals stand before a month, or after a word that takes a noun.
MONTHS = "januar jänner februar märz april mai juni juli august september oktober november dezember".split()
ORDINAL = "am vom zum beim im der die das den dem des ab bis".split()


def _by_language(words: dict[str, str]) -> dict[str | None, frozenset]:
    """The words of each language; under None those of all, for blocks whose language can't be told."""
    return {k: frozenset(x.split()) for k, x in words.items()} | {None: frozenset(w for x in words.values() for w in x.split())}


_TITLES, _COUNTED, _CLOSING, _FUNCTION = map(_by_language, (TITLES, COUNTED, CLOSING, FUNCTION))
_SAYING = _by_language(SAYING)
_LATIN = ("en", "de", "fr", "es")

# Property classes. A line end within a block is a blank; a point that leads a run (an ellipsis) is ATerm,
# and so is the ellipsis sign, which the standard leaves out. Close without what only opens.
_TERM = r"\p{SB=ATerm}\p{SB=STerm}…"
_SHUT = r"[[\p{SB=Close}]--[\p{Ps}]]"
_SP = r"[\p{SB=Sp}\n]"
_LATER = r"(?:[»”’)\]]|\"(?=\s|$))"  # closes after a blank as well
_compile = lambda p: re.compile("(?V1)" + p)
_CASED_MARK = _compile(rf"[{_TERM}]+(?:{_SHUT}+(?![\p{{L}}\p{{N}}])|{_SP}{_LATER}+(?=[\s.,;:!?]|$))*")
_GREEK_MARK = _compile(rf"[{_TERM};\u037e]+(?:{_SHUT}+(?![\p{{L}}\p{{N}}])|{_SP}{_LATER}+(?=[\s.,;:!?]|$))*")
#: Scripts of Han: a point only abbreviates or numbers, the wide one ends.
_HAN_MARK = _compile(rf"(?:[[{_TERM}]--[.]]|(?<!\.)\.{{3,4}}(?!\.))+(?:[\p{{SB=Sp}}\n]?[{_SHUT}--[\p{{Pi}}]]+)*")
#: Other scripts without case; a bar stands for a danda, a comma before a closing quote for a mark.
_OTHER_MARK = _compile(rf"(?:[{_TERM}]|(?<=[\p{{L}}\p{{M}}])\||[,،](?=[»”)]))+(?:{_SHUT}+|[ \u00a0\n][”»)\]]+(?=\s|$))*")
_THAI_MARK = _compile(rf"(?:[[{_TERM}]--[.]]|(?<!\.)\.{{3,4}}(?!\.))+(?:[ \n]?[”’»)\]]+)*|(?<=[\p{{Thai}}\p{{Lao}}])[”»)]+")
_MARKS_ONLY = _compile(rf"^[{_TERM};\u037e|,،]+")

_THAI = re.compile(r"[\p{Thai}\p{Lao}]")
_HAN = re.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
#: Letters without case (OLetter), but for the ordinal signs of Latin.
_UNCASED = re.compile(r"(?![ªº])\p{Lo}")
#: Scripts with a full stop of their own, in which a point only abbreviates.
_POINTLESS = re.compile(r"[\p{Devanagari}\p{Bengali}\p{Ethiopic}\p{Myanmar}\p{Khmer}\p{Tibetan}]")
_GREEK, _CYRILLIC = re.compile(r"\p{Greek}"), re.compile(r"\p{Cyrillic}")
_GOES_ON = _compile(r"[[\p{SB=SContinue}]--[—–]]|[\p{L}\p{N}/@;]")
_NEXT = re.compile(r"[\s\u00a0]*(?:[·|'.,*•¦:][\s]+)*([“«\"„(¿¡‘»”*'\[]*[\s\u00a0\u202f]?)([\p{L}\p{M}\p{N}]*)")
_BLANKS = ("", " ", "\n")
_OPENED = frozenset("“«\"„(¿¡‘»")
_SAYS = re.compile(r"[\p{L}.]+[ \n]\p{Ll}+[ ]?:")
_ROMAN = re.compile(r"[IVXLCDM]+$")
_SMALL = re.compile(r"\p{Ll}+")
_FIRST = re.compile(r"(?:^|[.!?…][\"'”’»«“)]*[ \n]+)[“«\"„(¿¡‘»]*[ \u00a0]?(\p{Lu}\p{Ll}*)(?=[ \n])")
_CAPITAL = re.compile(r"[ \n](?=(\p{Lu}\p{Ll}*)[ \n]\p{L})")
_SPECK = re.compile(r"(?:[\s\u00a0]+[·|'.,*•¦~^_`]+)+[\s\u00a0]*$")
_BLANK = re.compile(r"[ \u00a0\u3000]+\n?|\n[ \u00a0\u3000]+")
_SHORT_THAI = re.compile(r"[\p{Thai}]{1,5}\.")
_QUOTATIVE = re.compile(r"[ \n\u3000]*(?:って|と(?!ころ|もに|ても|にかく))")
_CLAUSE = re.compile(r"[ \n\u3000]*([^。！？，；：…、「『“:\n]{1,14}+)(?!\n?[：:])")


class Page:
    """A page's text and what its words tell, found when first asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def small(self) -> frozenset:
        """Words that stand in small letters somewhere."""
        return frozenset(_SMALL.findall(self.text))

    @cached_property
    def first(self) -> frozenset:
        """Words in capitals that open a sentence after a mark."""
        return frozenset(_FIRST.findall(self.text))

    @cached_property
    def language(self) -> str | None:
        first, second = _votes(self.text)[:2]
        return first[1] if first[0] > second[0] else None

    def opens(self, word: str, lang: str | None) -> bool:
        """Whether a word in capitals is a common one, which has them for the sake of its place: a function
        word of the language, or one that stands in small letters on the page and opens a sentence there."""
        if word.isupper() and len(word) > 1:
            word = word.capitalize()
        low = word.lower()
        return low in _FUNCTION.get(lang, _FUNCTION[None]) or low in self.small and word in self.first


def ends_of(text: str | None, boxes: tuple[list, list, list, list] | None, width: int | None) -> list[int]:
    """Positions, from 0, of the last character of each sentence of a page, ascending."""
    if not text or text.isspace():
        return []
    lines = lines_of(text)
    if boxes is not None and len(boxes[0]) == len(lines):
        parts = blocks(text, lines, *boxes, width)
    else:
        parts = plain_blocks(text, lines)
    out: set[int] = set()
    page, uncased = Page(text), _UNCASED.search(text) is not None
    for kind, numbers in parts:
        pieces, begins, at = [], [], 0
        for k in numbers:
            a, b = lines[k]
            begins.append(at)
            pieces.append(text[a:b])
            at += b - a + 1
        block = "\n".join(pieces)
        for e in _block_ends(block, kind, uncased, page):
            k = bisect_right(begins, e) - 1
            out.add(lines[numbers[k]][0] + e - begins[k])
    return sorted(out)


def _block_ends(block: str, kind: str, uncased: bool, page: Page) -> list[int]:
    if uncased and _UNCASED.search(block):
        if _THAI.search(block):
            found = _thai(block)
        elif _HAN.search(block):
            found = _han(block)
        else:
            found = _other(block)
    else:
        found = _cased(block, kind, page)
    close = len(block.rstrip())
    if not close:
        return found
    last = max(found, default=-1)
    if last < close - 1:
        speck = _SPECK.search(block, max(last, 0), close)
        if speck:
            first = speck.group().lstrip()[:1]
            close = speck.end() - len(speck.group().lstrip()) + 1 if first == "." else speck.start() or close
        rest = block[last + 1 : close]
        if any(c.isalnum() for c in rest):
            found.append(close - 1)
    return found


def _before(block: str, at: int) -> str:
    """The word that ends at the position, without quotes before it."""
    start = max(block.rfind(" ", 0, at), block.rfind("\n", 0, at), block.rfind("\u00a0", 0, at)) + 1
    return block[start:at].lstrip("“«\"„(¿¡‘»”'[")


def _votes(text: str) -> list[tuple[int, str]]:
    """Languages of Latin script by the number of their words, the most first."""
    words = text.lower().split()
    return sorted(((sum(map(_FUNCTION[k].__contains__, words)), k) for k in _LATIN), reverse=True)


def _language(block: str, page: Page) -> str | None:
    """Language of a block by its letters and words; where these are few, of the page; None where neither tells."""
    if _CYRILLIC.search(block):
        return "ru"
    if _GREEK.search(block):
        return "el"
    first, second = _votes(block)[:2]
    return first[1] if first[0] > second[0] + 1 else page.language or (first[1] if first[0] > second[0] else None)


def _cased(block: str, kind: str, page: Page) -> list[int]:
    """Scripts with case. The rules' numbers are those of the standard."""
    out = []
    lang = _language(block, page)
    for m in (_GREEK_MARK if lang == "el" else _CASED_MARK).finditer(block):
        start, end = m.span()
        found = m.group()
        marks = found if len(found) == 1 else _MARKS_ONLY.match(found).group()
        shut = len(marks) < len(found)
        if not shut and block[end : end + 1] not in _BLANKS and _GOES_ON.match(block, end):  # SB6, SB7, SB8a
            continue
        if len(marks) > 4 and marks.strip(".") == "":  # leaders
            continue
        nxt = _NEXT.match(block, end)
        opened, word = nxt.group(1).strip(), nxt.group(2)
        lone = start > 0 and block[start - 1].isspace()
        if not word:
            more = any(c.isalnum() for c in block[end : end + 12])
            if not shut and (lone and _done(block, start) or more) and marks == ".":
                continue
            out.append(end - 1)
            continue
        upper, lower = word[0].isupper(), word[0].islower()
        if "!" in marks or "?" in marks or ";" in marks or "\u037e" in marks:
            if start and not lone and not shut and block[end : end + 1] not in (" ", "\n", "\u00a0", "", "“", "«", "("):
                continue
            if not upper and not word[0].isdigit() and (kind == BODY or shut) and not opened:  # SB8, for STerm as well
                continue
            out.append(end - 1)
            continue
        if len(marks) > 1 or "…" in marks:
            if upper or opened and not lower:
                out.append(end - 1)
            continue
        if lone and not shut and (_done(block, start) or not upper or not page.opens(word, lang)):
            continue
        if not upper and not (opened and shut):  # SB8
            continue
        if not shut and not lone and _abbreviates(block, start, nxt, kind, lang, page):
            continue
        out.append(end - 1)  # SB11
    if kind == BODY:
        out += _lost(block, lang, page)
    return out


def _lost(block: str, lang: str | None, page: Page) -> list[int]:
    """Ends whose mark is lost, or misread as one that ends nothing: before a common word in capitals."""
    out = []
    titles = _TITLES.get(lang, _TITLES[None])
    for m in _CAPITAL.finditer(block):
        end = at = m.start()
        while at > max(0, end - 2) and block[at - 1] in ")]\"”’»“«":
            at -= 1
        c = block[at - 1 : at]
        misread = c != "" and c in ",·'" and block[at - 2 : at - 1].isalnum()
        if not (misread or c.islower() or c.isnumeric()) or not page.opens(m.group(1), lang):
            continue
        if misread or at < end or _before(block, end).lower() not in titles:
            out.append(end - 1)
    return out


def _abbreviates(block: str, start: int, nxt: re.Match, kind: str, lang: str | None, page: Page) -> bool:
    """Whether a point before a word in capitals belongs to the abbreviation, initial or number before it."""
    raw = _before(block, start)
    token = raw.lower()
    at = start - len(raw)
    opened, word = nxt.group(1).strip(), nxt.group(2)
    dotted = block[nxt.end() : nxt.end() + 1] == "."
    initial = len(word) == 1 and dotted
    titles, counted, closing = (x.get(lang, x[None]) for x in (_TITLES, _COUNTED, _CLOSING))
    number = token[-1:].isdigit()
    if not (number or len(token) == 1 or "." in token or token in titles or token in counted or token in closing or token.endswith("str")):
        return False
    begins = opened != "" and opened[0] in _OPENED
    opens = begins or not initial and page.opens(word, lang)
    before = block[:at].rstrip()
    last = _before(block, len(before))
    if number:
        if not before or kind != BODY:
            return not opens
        if lang in ("de", None) and token.isdigit() and len(token) < 3 and (word.lower() in MONTHS or last.lower() in ORDINAL):
            return True
        if last.lower().rstrip(".") in counted:
            return not (opens or _SAYS.match(block, nxt.start(2)))
        return False
    joined = last.lower() + token if len(last) < 4 and last.endswith(".") else token
    unit = len(token) == 1 and raw.islower() and last[-1:].isdigit()
    street = token.endswith("str") or token == "st" and lang == "en" and last[:1].isupper()
    if unit or street or token in closing or joined in closing:
        if kind != BODY:
            return not begins
        return initial or dotted and (word.lower() in titles or word.lower() in closing)
    if token in titles or joined in titles:
        return True
    if token in counted and len(token) > 1:
        return kind != BODY or _ROMAN.match(word) is not None
    return not (opens or raw.islower() and _SAYS.match(block, nxt.start(2)))  # initials and other letters with points


def _done(block: str, at: int) -> bool:
    """Whether what stands before a lone mark has an end already, so that the mark is a speck."""
    return block[:at].rstrip()[-1:] in ".!?…\"'”’»«“)]"


def _han(block: str) -> list[int]:
    out = []
    for m in _HAN_MARK.finditer(block):
        if m.group()[-1] in "」』”’）)】》〉" and _said_in_han(block, m.end()):
            continue
        out.append(m.end() - 1)
    return out


def _said_in_han(block: str, end: int) -> bool:
    """Whether a quotation is followed by its particle (Japanese), or by a clause that opens or closes with a verb of saying."""
    if _QUOTATIVE.match(block, end):
        return True
    clause = _CLAUSE.match(block, end)
    return clause is not None and (clause.group(1)[0] in _SAYING["zh"] or clause.group(1)[-1] in _SAYING["zh"])


def _other(block: str) -> list[int]:
    out = []
    pointless = _POINTLESS.search(block) is not None
    for m in _OTHER_MARK.finditer(block):
        start, end = m.span()
        found = m.group()
        marks = _MARKS_ONLY.match(found).group()
        shut = len(marks) < len(found)
        lone = start > 0 and block[start - 1].isspace()
        if marks == ".":
            if pointless and not shut:
                continue
            token = _before(block, start)
            if not shut and (lone or len(token) == 1 or token in _TITLES[None] or token in _COUNTED[None] or not token):
                if not (len(token) > 0 and end >= len(block.rstrip())):
                    continue
            if end < len(block) and not shut and not block[end].isspace():
                continue
            if not shut and token[-1:].isdigit() and end < len(block) and block[end : end + 2].strip()[:1].isdigit():  # SB6
                continue
        elif len(marks) > 4 and marks.strip(".") == "":
            continue
        elif marks[0] in ".…" and not shut and lone:
            continue
        if shut and _says_next(block, end):
            continue
        out.append(end - 1)
    return out


def _says_next(block: str, end: int) -> bool:
    """Whether the next word is a verb of saying."""
    rest = block[end : end + 24].split(None, 1)
    return bool(rest) and rest[0].rstrip(".,:؛،") in _SAYING[None]


def _thai(block: str) -> list[int]:
    """The marks of the rules, and blanks between clauses, since a sentence there mostly has no mark."""
    out = [m.end() - 1 for m in _THAI_MARK.finditer(block)]
    for m in _BLANK.finditer(block):
        start, end = m.span()
        if not start or end >= len(block):
            continue
        left = _before(block, start)
        right = block[end : end + 24].split(" ", 1)[0].split("\n", 1)[0]
        if not left or not right:
            continue
        last, first = left[-1], right[0]
        if not _THAI.match(last) or last == "ๆ":
            continue
        if not (_THAI.match(first) or first in "“\"(«‘" or first.isalpha()):
            continue
        if left.endswith("ฯลฯ"):
            out.append(start - 1)
            continue
        if "." in left or _SHORT_THAI.match(right):
            continue
        out.append(start - 1)
    return out


def sentence_ends(documents: DataFrame) -> DataFrame:
    """doc_id and end_pos of every sentence of every page.

    documents: doc_id, text, width, boxes (array of x, y, w, h, ...); other columns are ignored, lang
    too, since it may be wrong: the script of each block decides. end_pos counts code points from 0.
    Null, empty and blank texts have no sentences. Without boxes, or with another number of boxes
    than lines, the lines are read as they stand. A null doc_id stays null. Repeated rows are made
    distinct within a page, not over pages. No shuffle: each page is split by itself, in linear time.
    """
    from pyspark.sql import functions as F

    flat = documents.select(
        "doc_id",
        "text",
        F.col("width").cast("int").alias("width"),
        *[F.col(f"boxes.{c}").cast("array<int>").alias(c) for c in "xywh"],
    )
    return flat.mapInArrow(_run, "doc_id bigint, end_pos bigint")


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        texts, widths = batch.column("text").to_pylist(), batch.column("width").to_pylist()
        there = batch.column("x").is_valid().to_pylist()
        offsets, values = {}, {}
        for c in "xywh":
            column = batch.column(c)
            offsets[c] = column.offsets.to_pylist()
            values[c] = column.values.to_pylist()
        counts, ends = [], []
        for k in range(n):
            boxes = tuple(values[c][offsets[c][k] : offsets[c][k + 1]] for c in "xywh") if there[k] else None
            if boxes is not None and any(v is None for b in boxes for v in b):
                boxes = None
            found = ends_of(texts[k], boxes, widths[k])
            counts.append(len(found))
            ends.extend(found)
        rows = np.repeat(np.arange(n), counts)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(ends, pa.int64())], ["doc_id", "end_pos"])
