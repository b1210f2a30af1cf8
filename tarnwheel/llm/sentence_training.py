"""Weights of the sentence model: python -m tarnwheel.llm.sentence_training DOCUMENTS.parquet [ROWS]

Training texts are labelled in two ways. Marked text: the boundary rules with their word lists (sentence_rules.py) give
the ends of the sentences; the model sees characters and words only, so what the lists know it must learn from the
texts, and from short snippets made of each listed word. Copies of the paragraphs in which all words that are in no list
are scrambled teach it what to do beside a word that it has never seen. Stripped text: from paragraphs of
two and more sentences in every script all end marks are taken out (in Thai, where a blank ends a sentence, the blanks
between sentences too), and the text's own marks tell where the sentences end. Paragraphs that have no mark of their
own, headings and texts cut short, are kept as they are. An averaged structured perceptron fits emission and transition
weights, decoding with the same Viterbi search. At most ROWS rows (6,000 by default), those with the smallest hash of
their text, are used: the bound of the labelled sample.
"""

from __future__ import annotations

import random
import re
import sys
from pathlib import Path

import numpy as np
import xxhash

from . import sentence_rules as R
from .sentences import BITS, EDGE, HAN, KANA, LETTERS, N_CLASSES, N_NEAR, THAI, Model, View, class_of, features, near, paragraphs, viterbi

ROWS, ROUNDS, MARGIN = 6_000, 12, 20.0
SCRIPTS = {
    "th": re.compile("[฀-๿]"), "ja": re.compile("[぀-ヿ]"), "zh": re.compile("[一-鿿]"), "ar": re.compile("[؀-ۿ]"), "hi": re.compile("[ऀ-ॿ]"), "cyrillic": re.compile("[Ѐ-ӿ]"),
}
AFTER = re.compile(r'[.!?…。．｡！？।॥؟۔|\s”»」』）)\]"]*$')
Labelled = tuple[str, list[int], bool, int]  # paragraph, ends of its sentences, whether the text ends with it, times it counts


def script_of(p: str) -> str:
    """The most frequent script of a paragraph; kana make it Japanese."""
    n = {k: len(r.findall(p)) for k, r in SCRIPTS.items()}
    if n["ja"] * 8 > n["zh"] and n["ja"]:
        return "ja"
    best = max(n, key=n.get)
    return best if 2 * n[best] > sum(map(str.isalpha, p)) or best == "th" and n[best] else "latin"


def marked(texts: list[str]) -> list[Labelled]:
    """Each paragraph with the ends that the rules give."""
    out = []
    for t in texts:
        for _, p, short in paragraphs(t):
            if p and not p.isspace():
                out.append((p, R.boundaries(p, short), short, 1))
    return out


def stripped(p: str, ends: list[int], short: bool) -> Labelled | None:
    """The paragraph without its end marks, labelled by them; None where fewer than two sentences are left."""
    at, begin, parts = [], 0, []
    thai = script_of(p) == "th"
    for end in [*ends, len(p)]:
        s = p[begin:end]
        core = AFTER.sub("", s.rstrip())
        gap = p[end : end + 1] if not thai else ""
        lead = s[: len(s) - len(s.lstrip())]
        core = core.lstrip()
        if core and not R.PAIR.search(core):
            parts.append(("" if thai or not parts else (lead or (gap if gap.isspace() else ""))) + core)
            at.append(sum(map(len, parts)))
        begin = end
    q = "".join(parts)
    if len(at) < 2 or R.boundaries(q):
        return None
    return q, at[:-1], short, 1


def snippets(seed: int = 1) -> list[Labelled]:
    """Each listed word in short texts, labelled by the rules."""
    rnd = random.Random(seed)
    out = []
    latin = "The old man went home with a letter Die Frau kam heute spät nach Hause El hombre salió ayer La femme partit hier".split()
    words = {"c": "Он пришёл домой поздно вечером Старый мост стоит здесь".split(), "d": "राम घर गया और पानी लाया पुराना पुल यहाँ है".split(), "a": "ذهب الرجل إلى البيت مساء الجسر القديم هنا".split()}

    def pool(w: str) -> list[str]:
        o = max(map(ord, w))
        return words["c"] if 0x400 <= o < 0x500 else words["d"] if 0x900 <= o < 0x980 else words["a"] if 0x600 <= o < 0x700 else latin

    def cased(w: str) -> list[str]:
        return sorted({w, w.capitalize(), w[:1].upper() + w[1:]})

    for w in sorted(R.TITLES | R.LEADS | R.MAY_END | R.UNITS):
        for form in cased(w):
            x = pool(w)
            for _ in range(6):
                a, b, c, d = rnd.choices(x, k=4)
                number = str(rnd.randrange(1, 900))
                for p in (f"{a} {b} {form}. {c.capitalize()} {d}.", f"{a} {b} {form}. {c.lower()} {d}.", f"{a} {form}. {number} {b}. {c.capitalize()} {d}.", f"{a} {number} {form}. {b.capitalize()} {c} {d}."):
                    out.append((p, R.boundaries(p), False, 1))
    for i in range(26):
        for _ in range(5):
            a, b, c = rnd.choices(latin, k=3)
            letter = chr(65 + i)
            p = f"{a.capitalize()} {letter}. {b.capitalize()} {c.lower()} {chr(65 + rnd.randrange(26))}. {letter}. {b}. {c.capitalize()} {a}."
            out.append((p, R.boundaries(p), False, 1))
    for w in sorted(R.SAID):
        for o, c in (("“", "”"), ("«", "»"), ("„", "“"), ("« ", " »")):
            for _ in range(3):
                a, b, d = rnd.choices(pool(w), k=3)
                for p in (f"{o}{a} {b}?{c} {w} {d}. {a.capitalize()} {b}.", f"{o}{a} {b}!{c}, {w} {d}. {b.capitalize()} {a}.", f"{o}{a} {b}.{c} {d.capitalize()} {a}. {b}.", f"{a} {w}: {o}{b}. {d}.{c} {a.capitalize()} {d}.", f"{o}{a}?{c} {w} {d}: {o}{b}.{c}"):
                    out.append((p, R.boundaries(p), False, 1))
        for size in (3, 9, 30, 100, 300):
            x = pool(w)
            long = " ".join(rnd.choices(x, k=size))
            for p in (f"“{x[0]}?” {w} {long}. {x[1].capitalize()} {x[2]}.", f"“{x[0]}?” {w} {long}: “{x[1]}.”"):
                out.append((p, R.boundaries(p), False, 1))
    for w in sorted(R.CONJUNCTIONS):
        a, b, c, d = rnd.choices(pool(w), k=4)
        for p in (f"{a} {b}. {w} {c} {d}.", f"{a} {b}. {c.lower()} {d}.", f"{a} 3. {w} 4. {b}. {c.capitalize()}."):
            out.append((p, R.boundaries(p), False, 1))
    for x in (latin, words["c"]):
        for _ in range(200):
            a, b, c, d, e = (w.lower() for w in rnd.choices(x, k=5))
            p = rnd.choice((f"{a.capitalize()} {b}. {c} {d} {e}.", f"{a} {b} {c}. {d} {e}. {a} {c}.", f"{a.capitalize()} {b}.{c.capitalize()} {d}. {e} {a}."))
            out.append((p, R.boundaries(p), False, 1))
    people = "李明王师傅老人工程张三小红厨师司机阿强"
    for verb in "说 问 道 答 说道 问道".split():
        for _ in range(30):
            a, b = ("".join(rnd.choices(people, k=rnd.randrange(1, 9))) for _ in range(2))
            for p in (f"“{a}来了？”{b}{verb}。{a}走了。", f"“{a}！”{b}走了。{a}来了。", f"{b}{verb}：“{a}来了。”{b}走了。"):
                out.append((p, R.boundaries(p), False, 1))
    for w in sorted(R.ORDINAL_BEFORE):
        for n in range(1, 32):
            a, b, c, d = rnd.choices(latin, k=4)
            p = f"{a} {w} {n}. {b.capitalize()} {c}. {d.capitalize()} {a} {b} {n}. {c.capitalize()} {d}."
            out.append((p, R.boundaries(p), False, 1))
    return out


WORD_OF = re.compile(r"[^\s“”«»„「」()（）,:;!?…。，、！？।|]+")


LISTED = R.TITLES | R.LEADS | R.MAY_END | R.UNITS | R.SAID | R.CONJUNCTIONS | R.ORDINAL_BEFORE | R.SPEECH_WORDS


def scrambled(p: str, rnd: random.Random) -> str:
    """The paragraph with random letters, of the same script and case, in most words that are in no list; some are left out."""
    pools: dict[int, list[str]] = {}
    for c in p:
        if (k := class_of(c)) in LETTERS:
            pools.setdefault(k, []).append(c)
    fewer = rnd.random() < 0.5

    def other(m: re.Match) -> str:
        w = m.group()
        core = w.rstrip(".").casefold()
        if core in LISTED or len(core) < 2:
            return w
        if class_of(w[0]) in (HAN, KANA, THAI):  # no words are to be seen: letter by letter
            few = rnd.random() < 0.5
            return "".join(c if rnd.random() < 0.5 or class_of(c) not in LETTERS else "" if few else rnd.choice(pools[class_of(c)]) for c in w)
        if rnd.random() < 0.2:
            return w
        if fewer and rnd.random() < 0.3 and w.isalpha():
            return ""
        return "".join(rnd.choice(pools[class_of(c)]) if class_of(c) in LETTERS else c for c in w)

    return WORD_OF.sub(other, p)


def stretch(p: str, rnd: random.Random) -> str:
    """Some successive sentences of a paragraph; now and then first letters are small, the blanks between are gone, or lines are broken."""
    cuts = [0, *R.boundaries(p), len(p)]
    a = rnd.randrange(len(cuts) - 1)
    parts = [p[x:z].strip() for x, z in zip(cuts[a:], cuts[a + 1 : a + 1 + rnd.randrange(1, 5)])]
    if rnd.random() < 0.3:
        parts = [s[:1].lower() + s[1:] if rnd.random() < 0.5 else s for s in parts]
    q = ("" if rnd.random() < 0.1 else " ").join(parts)
    return re.sub(r"(?<!\n) (?!\n)", lambda m: "\n" if rnd.random() < 0.15 else " ", q) if rnd.random() < 0.3 else q


def scrambles(real: list[Labelled], copies: int = 2, seed: int = 2) -> list[Labelled]:
    rnd = random.Random(seed)
    out = []
    for p, ends, short, _ in real:
        for _ in range(copies):
            q = stretch(p, rnd) if len(p) > 600 or rnd.random() < 0.6 else p
            if R.boundaries(q) or AFTER.search(q).group().strip():
                q = scrambled(q, rnd).strip()
                if q:
                    out.append((q, R.boundaries(q, short), short, 1))
    return out


def labelled(texts: list[str]) -> tuple[list[Labelled], list[Labelled]]:
    """(the paragraphs of the texts, stripped stretches of them); paragraphs without marks of their own count three times."""
    real = marked(texts)
    made = [s for p, ends, _, _ in real for s in bare(p, ends)]
    return [(p, ends, short, 1 if ends or AFTER.search(p).group().strip() else 3) for p, ends, short, _ in real], made


def bare(p: str, ends: list[int], seed: int = 1) -> list[Labelled]:
    """Stripped stretches of two to five successive sentences of a paragraph."""
    out, k, rnd = [], 0, random.Random(f"{seed} {len(p)} {p[:50]}")
    cuts = [0, *ends, len(p)]
    while k + 2 < len(cuts):
        n = min(rnd.randrange(2, 6), len(cuts) - 1 - k)
        s = stripped(p[cuts[k] : cuts[k + n]], [e - cuts[k] for e in cuts[k + 1 : k + n]], False)
        if s:
            out.append(s)
        k += n
    return out


def _gold(v: View, ends: list[list[int]]) -> np.ndarray:
    gold = np.zeros(len(v.u), bool)
    for a, e in zip(v.begin, ends):
        gold[a + np.array(e, np.int64) - 1] = True
    return gold


def gates_of(data: list[Labelled], made: list[Labelled]) -> np.ndarray:
    """Which pairs of classes have a boundary between them in marked, and in stripped paragraphs."""
    gates = np.zeros((2, N_CLASSES, N_CLASSES), bool)
    for mode, part in enumerate((data, made)):
        if part:
            v = View([(p, short) for p, _, short, _ in part])
            i = np.flatnonzero(_gold(v, [e for _, e, _, _ in part]))
            seen = np.bincount(v.cls[i].astype(np.int64) * N_CLASSES + v.cls[i + 1], minlength=N_CLASSES**2)
            gates[mode] = (seen.reshape(N_CLASSES, N_CLASSES) >= 3) & (np.arange(N_CLASSES) != EDGE)[:, None]
    return gates


def _chains(model: Model, data: list[Labelled], mode: int, labels: bool) -> list[tuple]:
    """(mode, features, distances, tags) of each paragraph with open characters, as often as it counts."""
    out = []
    for a in range(0, len(data), 2000):
        part = data[a : a + 2000]
        v = View([(p, short) for p, _, short, _ in part])
        i = model.open(v, mode)
        if not len(i):
            continue
        f = np.stack(features(v, i, np.full(len(i), mode)), 1)
        gold = _gold(v, [e if labels else [] for _, e, _, _ in part])[i].astype(int)
        para = v.para[i]
        cuts = np.flatnonzero(np.r_[True, para[1:] != para[:-1]])
        for x, z in zip(cuts, [*cuts[1:], len(i)]):
            out += [(mode, f[x:z], near(np.diff(i[x:z], prepend=i[x] - 1000)).tolist(), gold[x:z].tolist())] * part[para[x]][3]
    return out


def train(texts: list[str], rounds: int = ROUNDS, extra: list[Labelled] | None = None, seed: int = 1, margin: float = MARGIN) -> Model:
    """Averaged structured perceptron with a margin, for both modes at once."""
    real, made = labelled(texts)
    real += scrambles(real)
    if extra is None:
        extra = snippets()
        extra += scrambles(extra)
    real += extra
    model = Model(np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros((2, N_NEAR, 2, 2)), gates_of(real, made))
    v = View([(p, short) for p, _, short, _ in real])
    bare = [x for x, ended in zip(real, v.ended) if not ended and not x[1]]
    chains = _chains(model, real, 0, True) + _chains(model, made, 0, False) + _chains(model, made, 1, True) + _chains(model, bare, 1, True)
    rnd = random.Random(seed)
    w, m = np.zeros(1 << BITS), np.zeros((2, N_NEAR, 4))
    sw, sm, step = np.zeros_like(w), np.zeros_like(m), 1
    for r in range(rounds):
        rnd.shuffle(chains)
        wrong = 0
        for mode, f, gap, gold in chains:
            g = np.array(gold)
            e = w[f].sum(1) + margin * (1 - 2 * g)  # each tag must win by the margin
            got = viterbi(e.tolist(), gap, m[mode].tolist())
            if got != gold:
                d = g - np.array(got)
                wrong += int(np.abs(d).sum())
                for k in np.flatnonzero(d):
                    np.add.at(w, f[k], d[k])
                    np.add.at(sw, f[k], step * d[k])
                for sign, tags in ((1, gold), (-1, got)):
                    move = np.array([0, *tags[:-1]]) * 2 + np.array(tags)
                    np.add.at(m[mode], (gap, move), sign)
                    np.add.at(sm[mode], (gap, move), step * sign)
            step += 1
        print(f"round {r + 1}: {wrong} tags wrong or within the margin", flush=True)
    w, m = w - sw / step, m - sm / step
    place = np.flatnonzero(np.abs(w) > 0.02)
    return Model(place, w[place].astype(np.float16).astype(np.float32), m.reshape(2, N_NEAR, 2, 2), model.gates)


def agreement(model: Model, data: list[Labelled]) -> dict[str, tuple[int, int, int]]:
    """By script: boundaries of the labels, of the model, of both."""
    out: dict[str, np.ndarray] = {}
    for a in range(0, len(data), 1000):
        part = data[a : a + 1000]
        v = View([(p, short) for p, _, short, _ in part])
        hits = model.decode(v)
        at = np.searchsorted(hits, np.r_[v.begin, len(v.u)])
        for k, (p, ends, _, _) in enumerate(part):
            got = set((hits[at[k] : at[k + 1]] - v.begin[k] + 1).tolist())
            out.setdefault(script_of(p), np.zeros(3, int))[:] += len(set(ends)), len(got), len(got & set(ends))
    return {k: tuple(map(int, x)) for k, x in sorted(out.items())}


def sample(path: str) -> list[str]:
    import pyarrow.parquet as pq

    return sorted({t for t in pq.read_table(path, columns=["text"]).column("text").to_pylist() if t}, key=lambda t: xxhash.xxh64_intdigest(t))


def report(model: Model, texts: list[str]) -> None:
    real = marked(texts)
    made = [s for p, ends, _, _ in real for s in bare(p, ends)]
    still = Model(model.place, model.weight, np.zeros_like(model.moves), model.gates)
    for name, data in (("marked", real), ("stripped", made)):
        plain = agreement(still, data)
        for k, (n, got, both) in agreement(model, data).items():
            print(f"{name} {k}: {n} boundaries, {got} found, {both} in both: recall {both / max(n, 1):.4f}, precision {both / max(got, 1):.4f}; without transitions {plain[k][1]} found, {plain[k][2]} in both")


def main(path: str, rows: int = ROWS) -> None:
    texts = sample(path)
    model = train(texts[:rows])
    print(f"{min(rows, len(texts))} texts, {len(model.place)} weights; moves by mode and distance {np.round(model.moves.reshape(2, N_NEAR, 4), 1).tolist()}; held out:")
    report(model, texts[rows:])
    model.save(str(Path(__file__).with_name("sentence_weights.npz")))


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:3]))
