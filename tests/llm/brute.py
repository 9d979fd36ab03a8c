"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def base_counts(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    tri = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(inside)


PHRASES = (
    "licensed under", "released under the", "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies",
    "javascript", "lorem ipsum", "click here", "subscribe to", "sign up", "log in", "back to top", "share this", "powered by",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "verwendet cookies", "hier klicken", "nach oben", "newsletter abonnieren", "lizenziert unter",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "utilise des cookies", "cliquez ici", "haut de page", "abonnez-vous", "sous licence",
    "todos los derechos reservados", "términos de uso", "política de privacidad", "utiliza cookies", "haga clic aquí", "volver arriba", "suscríbete a", "bajo licencia",
)


def judged(text):
    """Whether the line rules keep a text, line by line."""
    t = text or ""
    every, total, lost, seen, before = WORD.findall(t), 0, 0, set(), None
    if len(every) < 50 or 100 * base_counts(t)[4] > 50 * len(every):
        return False
    for line in t.split("\n"):
        w = WORD.findall(line)
        if not w:
            continue
        echo = 0
        for x in w:
            echo += x == before
            before = x
        n, letters = len(w), sum(c.isascii() and c.isalpha() for c in line)
        bad = n >= 5 and sum("A" <= c <= "Z" for c in line) > 0.7 * letters
        bad |= sum(c in "#*$%&<>!" for c in line) > 0.34 * n
        bad |= n < 3 and ord(w[-1][-1]) < 0x800 and w[-1][-1] not in ".!?\"';:)]»"
        bars = sum(c in "|>" for c in line)
        bad |= bars >= 3 and bars > 0.15 * n
        bad |= line in seen or (n >= 8 and echo > 0.4 * n)
        bad |= any(p in line.translate(_SMALL) for p in PHRASES)
        seen.add(line)
        total += sum(map(len, w))
        lost += bad * sum(map(len, w))
    return lost / max(total, 1) <= 0.3


def removed_bytes(rows, n=100):
    least, raw = {}, [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for p in range(len(b) - n + 1):
            least[b[p : p + n]] = min(least.get(b[p : p + n], (i, p)), (i, p))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if least[b[p : p + n]] < (i, p):
                gone[p : p + n] = b"\1" * n
        spans = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return sorted(out)


def removed_words(rows, n=50):
    docs, least = [(i, WORD.findall(t or "")) for i, t in rows], {}
    for i, w in docs:
        for p in range(len(w) - n + 1):
            k = tuple(w[p : p + n])
            least[k] = min(least.get(k, i), i)
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            if least[tuple(w[p : p + n])] < i:
                gone[p : p + n] = [True] * n
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode())))
    return sorted(out)


def shingles(text, size):
    w = WORD.findall((text or "").translate(_SMALL))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(rows, size=3, percent=90):
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for e in s:
            holders[e].append(i)
    for i, s in sets.items():
        for j, both in collections.Counter(j for e in s for j in holders[e] if j < i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return sorted((i, len(sets[i]), find(i)) for i, _ in rows)
