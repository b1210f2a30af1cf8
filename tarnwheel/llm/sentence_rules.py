"""Boundary rules with word lists: the teacher that labels the training texts of the sentence model. Nothing else uses it."""

from __future__ import annotations

import re

from .sentences import PAIR, pairs_of


THAI = "\u0e00-\u0e7f"
CJK = "\u3005-\u30ff\u3400-\u9fff\uff66-\uff9f"
EVENT = re.compile(rf"[.!?…。．｡！？।॥؟۔|]+|(?<=[{THAI}”»」』）)\]]) +(?=[{THAI}“«「『（(\[])")
OPENERS, CLOSERS, QUOTES = frozenset("“„«「『（([\"¿¡‘"), frozenset("”»」』）)]\"’"), frozenset("”»」』\"“")
TOKEN = re.compile(rf"[^\s(«\[,;:!?\u201a-\u201f\u2026\u3000-\u3004\u3008-\u3011{CJK}\uff00-\uffef]*$")
NEXT_WORD = re.compile(r"[^\W\d_][^\s.,;:!?।؟،。，…“”«»()]*")
CLAUSE_STOP = re.compile(r"[.!?…。．｡！？।؟|,，:：“”«»「」]")
SPEECH_FOLLOWS = re.compile(r"\s*(?:[:：]|[,，]\s*[“«„「\"])")
STRONG, DOTS = frozenset("!?。｡！？।॥؟۔|"), frozenset(".…")
#: A name follows, or a number or an example: the point ends nothing. Those of MAY_END end a sentence where a new one follows.
TITLES = frozenset("dr mr mrs ms prof st sr sra srta mme mlle hr д-р г-н г-жа ул проф им डॉ श्री प्रो د أ".split())
LEADS = frozenset("no nr nos pp vol fig ca approx env aprox vgl cf см стр рис напр прибл тел pág núm ej ex i.e e.g d.h z.b c.-à-d т.е n.º पृ क्र कि मि सें कि.ग्रा कि.मी ص انظر".split())
MAY_END = frozenset("etc usw bzw т.д т.п др إلخ co inc ltd corp jr u.a kg km cm mm кг км см3 كغ इत्यादि".split())
UNITS = frozenset("m g h l t м г ч л т с s".split())
SAID = frozenset(
    "said asked replied answered wrote sagte fragte antwortete meinte dijo preguntó respondió dit demanda répondit "
    "сказал сказала спросил спросила ответил ответила قال قالت سأل سألت أجاب أجابت".split()
)
SAID_AT_END = re.compile(r"(?:说|问|道|答|说道|问道|ने\s+कहा|ने\s+पूछा|said|asked|replied|ถาม|พูด)\s*$")
SPEECH_WORDS = frozenset("ने कहा पूछा".split())
CONJUNCTIONS = frozenset("and or und oder y o et ou и или и/или & sowie".split())
ORDINAL_BEFORE = frozenset("am vom zum der den dem des im beim ab bis seit".split())
WHITE = re.compile(r"\s*")


def _kind(c: str) -> str:
    """Class of the character with which what follows begins."""
    if not c:
        return "end"
    o = ord(c)
    if c.isalpha():
        if 0x0E00 <= o < 0x0E80:
            return "thai"
        if 0x3005 <= o < 0x3100 or 0x3400 <= o < 0xA000 or 0xFF66 <= o < 0xFFA0:
            return "cjk"
        return "upper" if c.isupper() else "lower" if c.islower() else "nocase"
    if c.isdigit():
        return "digit"
    if c in "“„«「『\"¿¡‘":
        return "open"
    if c in "（([":
        return "paren"
    return "punct" if c in ",;:、，；：—–-،؛)»”」』）]/%&=+*~" else "other"


def _ahead(p: str, a: int) -> str:
    """The last character before a that is no white space."""
    a -= 1
    while a >= 0 and p[a].isspace():
        a -= 1
    return p[a] if a >= 0 else ""


def _before(p: str, a: int) -> str:
    """Class of what stands before a point."""
    c = p[a - 1 : a]
    if not c:
        return "none"
    if c.isdigit():
        return "num"
    if _kind(c) == "cjk":
        return "cjk"
    tok = TOKEN.search(p, max(0, a - 16), a).group()
    if not tok:
        return "close" if c in CLOSERS else "space" if c.isspace() else "mark"
    t = tok.casefold()
    if len(t) == 1 and t.isalpha():
        lead = p[max(0, a - 5) : a - 1]
        if t in UNITS and lead.rstrip()[-1:].isdigit():
            return "may_end"
        if t in "дп" and lead.endswith(("т. ", "т.")):
            return "may_end"
        if t == "a" and lead.casefold().endswith(("u. ", "u.\xa0")):
            return "may_end"
        return "letter"
    if t in TITLES:
        return "title"
    if t in LEADS:
        return "lead"
    if t in MAY_END:
        return "may_end"
    if len(t) == 3 and t[1] == "." and t[0].isalpha() and t[2].isalpha():
        return "letter"
    return "close" if c in CLOSERS else "word"


class _Clauses:
    """Where the clauses of a paragraph end, asked for places in ascending order; every character is passed once."""

    def __init__(self, p: str):
        self.p, self.end, self.introduces = p, -1, False

    def at(self, k: int) -> tuple[int, bool]:
        """(end of the clause at k, whether it introduces the next quote)."""
        if k > self.end:
            m = CLAUSE_STOP.search(self.p, k)
            self.end = m.start() if m else len(self.p)
            self.introduces = bool(SPEECH_FOLLOWS.match(self.p, self.end))
        return self.end, self.introduces


def _said(p: str, k: int, nxt: str, clauses: _Clauses) -> bool:
    """Whether the clause that follows a quote only says who spoke."""
    if nxt == "cjk" and p[k] in "とっ":
        return True
    end, introduces = clauses.at(k)
    if introduces:
        return False
    if nxt in ("lower", "upper", "nocase"):
        w = NEXT_WORD.match(p, k)
        if w and w.group().casefold() in SAID:
            return True
    if end - k > 60:
        return False
    clause = p[k:end]
    return len(clause.split()) <= 6 and bool(SAID_AT_END.search(clause))


def candidates(p: str, cut_short: bool = False) -> list[tuple[int, tuple]]:
    """(end, features) of each character of a paragraph that could end a sentence, but for its last. cut_short: the text ends with it."""
    out: list[tuple[int, tuple]] = []
    pairs = pairs_of(p, cut_short) if PAIR.search(p) else {}
    spans = sorted((o, c) for c, o in pairs.items())
    small = not any(c.isupper() for c in p) if EVENT.search(p) else False
    n, last, reach, s, clauses = len(p), 0, -1, 0, _Clauses(p)
    for m in EVENT.finditer(p):
        a, b = m.span()
        if a < last:
            continue
        while s < len(spans) and spans[s][0] < a:
            reach = max(reach, spans[s][1])
            s += 1
        mark = m.group()
        if mark[0] == " ":
            if reach >= b:
                continue
            left, right = p[a - 1], p[b]
            out.append((a, ("blank", _kind(left) if left.isalpha() else "thai" if "\u0e00" <= left <= "\u0e7f" else "close" if left in CLOSERS else "other", "thai" if "\u0e00" <= right <= "\u0e7f" else _kind(right), "blank", "", "")))
            continue
        if mark in (".", "．") and p[a - 1 : a].isdigit() and p[b : b + 1].isdigit():
            continue
        if mark[0] == "|" and not (_ahead(p, a) in (")", "”") or "\u0900" <= _ahead(p, a) <= "\u097f"):
            continue
        j, closed = b, ""
        while j < n:
            k = WHITE.match(p, j).end()
            c = p[k : k + 1]
            if c in CLOSERS or c == "“":
                if k in pairs and pairs[k] < a:
                    closed = "quote" if c in QUOTES else closed or "bracket"
                    j = k + 1
                    continue
                if k == j and k not in pairs and c in "”»」』）)]":
                    j = k + 1
                    continue
            break
        last = j
        if reach >= j:
            continue
        k = WHITE.match(p, j).end()
        if k >= n:
            break
        nxt = _kind(p[k])
        gap = "none" if k == j else "line" if "\n" in p[j:k] else "blank"
        if any(c in STRONG for c in mark):
            kind, prev = "strong", ""
        elif len(mark) > 1 or mark == "…":
            ended = mark[0] == "…" and mark[-1] in ".．"  # dots of omission with an end mark behind them
            kind, prev = "dots", "cjk" if _kind(_ahead(p, a)) == "cjk" and not ended else ""
        else:
            kind, prev = "dot", _before(p, a)
            if prev == "num" and gap != "none":
                w = p[max(0, a - 12) : a].split()
                if len(w) > 1 and w[-1].isdigit() and len(w[-1]) < 3 and w[-2].casefold() in ORDINAL_BEFORE:
                    prev = "ordinal"
        extra = ""
        if closed == "quote" and nxt not in ("punct", "open", "paren") and _said(p, k, nxt, clauses):
            extra = "said"
        elif nxt == "lower":
            w = NEXT_WORD.match(p, k)
            extra = "and" if w and w.group() in CONJUNCTIONS else "small" if small else ""
        out.append((j, (kind, prev, nxt, gap, closed, extra)))
    return out


def rule(f: tuple) -> int:
    """1 where the candidate with these features ends a sentence."""
    kind, prev, nxt, gap, closed, extra = f
    if kind == "blank":  # a script without end marks, no Latin letter or digit beside it
        return int(prev in ("thai", "close") and nxt in ("thai", "open", "paren"))
    if nxt in ("punct", "end") or extra == "said":
        return 0
    if kind == "strong":
        return 1
    if kind == "dots":
        return int(prev != "cjk" and nxt != "lower")
    if prev in ("title", "lead", "letter", "ordinal"):
        return 0
    if prev == "may_end":
        return int(nxt == "upper" if gap == "none" else nxt in ("upper", "open", "nocase", "cjk", "thai") or (nxt == "lower" and extra == "small"))
    if nxt == "lower":
        return int(gap != "none" and extra != "and")
    if nxt == "digit":
        return int(gap != "none")
    return int(prev not in ("none",))


def boundaries(p: str, cut_short: bool = False) -> list[int]:
    """Ends of the sentences inside a paragraph, by the rules."""
    return sorted({end for end, f in candidates(p, cut_short) if rule(f)})
