"""SMILES text: tokens, validity, atoms and bonds, and forms that are equal for equal texts.

No chemistry toolkit is used. ``problem`` and ``canonical`` work on text alone; ``parse`` gives atoms and bonds.
"""

from __future__ import annotations

import re

# The chemical elements in the order of their atomic numbers.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb "
    "Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es "
    "Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
NUMBER = {s: i + 1 for i, s in enumerate(ELEMENTS)}
# Atoms that may stand without brackets, and those that may be aromatic within them.
ORGANIC = ("Cl", "Br", "B", "C", "N", "O", "P", "S", "F", "I")
AROMATIC = ("b", "c", "n", "o", "p", "s")
AROMATIC_IN_BRACKETS = ("se", "as", "te", *AROMATIC)
BOND_ORDER = {"-": 1.0, "/": 1.0, "\\": 1.0, "=": 2.0, "#": 3.0, "$": 4.0, ":": 1.5}

_symbols = "|".join(sorted(ELEMENTS, key=lambda s: -len(s)))
BRACKET = re.compile(rf"\[(\d+)?({_symbols}|{'|'.join(AROMATIC_IN_BRACKETS)}|\*)(@(?:@|TH[12]|AL[12]|SP[1-3]|TB\d\d?|OH\d\d?)?)?(H\d*)?(\++\d*|-+\d*)?(:\d+)?\]")
TOKEN = re.compile(r"(\[[^\[\]]*\])|(Cl|Br|[BCNOPSFI]|[bcnops]|\*)|(%\d\d|%\(\d+\)|\d)|([-=#$:/\\])|([().])")


def problem(text: str | None) -> str | None:
    """Why ``text`` is no SMILES: ``empty``, ``symbol``, ``bracket``, ``parenthesis``, ``ring`` or ``no_atom``; None if it is one."""
    if not text:
        return "empty"
    pos, depth, atoms, rings = 0, 0, 0, set()
    while pos < len(text):
        m = TOKEN.match(text, pos)
        if m is None:
            return "bracket" if text[pos] in "[]" else "symbol"
        bracket, atom, ring, _, other = m.groups()
        if bracket:
            if not BRACKET.fullmatch(bracket):
                return "symbol"
            atoms += 1
        elif atom:
            atoms += 1
        elif ring:
            rings ^= {int(ring.strip("%()"))}
        elif other == "(":
            depth += 1
        elif other == ")":
            depth -= 1
            if depth < 0:
                return "parenthesis"
        pos = m.end()
    if depth:
        return "parenthesis"
    if rings:
        return "ring"
    return None if atoms else "no_atom"


def parse(text: str | None) -> tuple[list[tuple], list[tuple]] | None:
    """Atoms ``(number, charge, explicit_hs, aromatic, isotope, chirality, map)`` and bonds ``(begin, end, order, mark)``; None if unparsable."""
    if problem(text) is not None:
        return None
    atoms: list[tuple] = []
    bonds: list[tuple] = []
    stack: list[int | None] = []
    open_rings: dict[int, tuple[int, str | None]] = {}
    last: int | None = None
    bond: str | None = None

    def link(a: int, b: int, mark: str | None) -> None:
        aromatic = mark == ":" or mark is None and atoms[a][3] and atoms[b][3]
        bonds.append((a, b, 1.5 if aromatic else BOND_ORDER[mark or "-"], mark if mark in ("/", "\\") else None))

    for m in TOKEN.finditer(text):
        bracket, atom, ring, mark, other = m.groups()
        if bracket or atom:
            if bracket:
                iso, sym, chiral, hs, charge, mapped = BRACKET.fullmatch(bracket).groups()
                q = 0
                if charge:
                    digits = charge.lstrip("+-")
                    q = (1 if charge[0] == "+" else -1) * (int(digits) if digits else len(charge))
                row = (NUMBER.get(sym.capitalize(), 0), q, int(hs[1:] or 1) if hs else 0, sym.islower(), int(iso) if iso else 0, chiral or "", int(mapped[1:]) if mapped else 0)
            else:
                row = (NUMBER.get(atom.capitalize(), 0), 0, 0, atom.islower(), 0, "", 0)
            atoms.append(row)
            if last is not None:
                link(last, len(atoms) - 1, bond)
            last, bond = len(atoms) - 1, None
        elif ring:
            n = int(ring.strip("%()"))
            if last is None:
                return None
            if n in open_rings:
                at, first = open_rings.pop(n)
                link(at, last, bond or first)
            else:
                open_rings[n] = (last, bond)
            bond = None
        elif mark:
            bond = mark
        elif other == "(":
            stack.append(last)
        elif other == ")":
            last, bond = stack.pop(), None
        else:
            last, bond = None, None
    return atoms, bonds


# Characters without a width, and marks that stand around a value without meaning in it.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b-\u200f\u2028-\u202e\u2060-\u2064\u2066-\u2069\ufeff"
AROUND = "\"'`\u00b4\u201c\u201d\u201e\u201f\u2018\u2019\u201a\u201b\u00ab\u00bb\u2039\u203a<>|,;:!?{}_~^&\u00b7\u2022\u2026.-\u2013\u2014"
_gone = re.compile(rf"[\s{INVISIBLE}\x00-\x1f\x7f-\x9f]+")
_part = re.compile(r"(\[[^\[\]]*\])|([^\[\]]+|[\[\]])")
_halogen = re.compile(r"[cC][lL]|[bB][rR]")


def _bracket(text: str) -> str:
    """A bracket atom with its symbol in the usual letter case, where only one reading is an atom."""
    if BRACKET.fullmatch(text):
        return text
    m = re.fullmatch(r"\[(\d*)([A-Za-z]+|\*)(.*)\]", text, re.S)
    if not m:
        return text
    iso, letters, rest = m.groups()
    # The written case first, then the usual case of two letters, then of one, each with what follows in upper case.
    for n in (2, 1):
        if len(letters) < n or n == 2 and letters[0] in "bcnopsBCNOPS" and letters[1] in "hH":
            continue
        head, tail = letters[:n], letters[n:].upper()
        for sym in (head, head.capitalize()):
            candidate = f"[{iso}{sym}{tail}{rest.upper()}]"
            if BRACKET.fullmatch(candidate):
                return candidate
    return text


def canonical(text: str | None, stereo: bool = True) -> str | None:
    """The text without white space, invisible characters, marks around it, written-out single bonds and uneven letter case, its
    components in order. None for null and for texts of which nothing is left. ``stereo=False`` also drops ``/``, ``\\`` and the
    chirality of carbon-like atoms. Aromatic and aliphatic atoms, charges, bond orders and components stay."""
    if text is None:
        return None
    t = _gone.sub("", text)
    while True:
        u = t.strip(AROUND)
        if len(u) > 1 and u[0] == "(" and u[-1] == ")":
            depth = 0
            for i, c in enumerate(u):
                depth += (c == "(") - (c == ")")
                if depth == 0:
                    break
            if i == len(u) - 1:
                u = u[1:-1]
        if u == t:
            break
        t = u
    if not t:
        return None
    out = []
    for bracket, plain in _part.findall(t):
        if bracket:
            b = _bracket(bracket)
            if not stereo and "@" in b:
                m = BRACKET.fullmatch(b)
                if m and not (m[1] or m[5] or m[6]) and (m[2] in ORGANIC or m[2] in AROMATIC):
                    b = m[2]
                elif m:
                    b = b.replace(m[3], "", 1)
            out.append(b)
        else:
            p = _halogen.sub(lambda m: m[0].capitalize(), plain).replace("-", "")
            if not stereo:
                p = p.replace("/", "").replace("\\", "")
            out.append(p)
    parts = sorted(p for p in "".join(out).split(".") if p)
    return ".".join(parts) or None


def write(atoms: list[tuple], bonds: list[tuple]) -> str:
    """A SMILES of atoms and bonds as :func:`parse` gives them, without stereo marks. Atoms are read depth first in their order; the
    text parses to the same graph, but is no canonical form."""
    near: list[list[tuple[int, float, int]]] = [[] for _ in atoms]
    for k, (a, b, order, *_) in enumerate(bonds):
        near[a].append((b, order, k))
        near[b].append((a, order, k))

    def atom(i: int) -> str:
        number, charge, hs, aromatic, isotope, _, mapped = atoms[i]
        symbol = ELEMENTS[number - 1] if number else "*"
        text = symbol.lower() if aromatic else symbol
        if (symbol in ORGANIC or symbol == "*") and not (charge or hs or isotope or mapped):
            return text
        sign = "" if not charge else ("+" if charge > 0 else "-") + (str(abs(charge)) if abs(charge) > 1 else "")
        return f"[{isotope or ''}{text}{('H' + (str(hs) if hs > 1 else '')) if hs else ''}{sign}{f':{mapped}' if mapped else ''}]"

    def bond(a: int, b: int, order: float) -> str:
        both = atoms[a][3] and atoms[b][3]
        return {1.0: "-" if both else "", 1.5: "" if both else ":", 2.0: "=", 3.0: "#", 4.0: "$"}[float(order)]

    seen, parts = [False] * len(atoms), []
    for root in range(len(atoms)):
        if seen[root]:
            continue
        # Depth first without recursion: the tree's edges, and the bonds that close rings.
        order_of, parent, rings, used = [], {root: (-1, 0.0)}, [], set()
        stack = [(root, -1, 0.0, -1)]
        while stack:
            i, p, order, k = stack.pop()
            if k in used:
                continue
            used.add(k)
            if seen[i]:
                rings.append((p, i, order))
                continue
            seen[i] = True
            parent[i] = (p, order)
            order_of.append(i)
            stack += [(j, i, o, b) for j, o, b in reversed(near[i]) if b not in used]
        place = {i: n for n, i in enumerate(order_of)}
        opens: dict[int, list[int]] = {}
        closes: dict[int, list[int]] = {}
        for n, (a, b, _) in enumerate(rings):
            first, last = sorted((a, b), key=place.__getitem__)
            opens.setdefault(first, []).append(n)
            closes.setdefault(last, []).append(n)
        label, free, marks = {}, list(range(99, 0, -1)), {}
        for i in order_of:
            text = []
            for n in closes.get(i, ()):
                d = label[n]
                text.append(bond(*rings[n]) + (str(d) if d < 10 else f"%{d}"))
                free.append(d)
            for n in opens.get(i, ()):
                label[n] = d = free.pop()
                text.append(bond(*rings[n]) + (str(d) if d < 10 else f"%{d}"))
            marks[i] = "".join(text)
        children: dict[int, list[int]] = {}
        for i in order_of[1:]:
            children.setdefault(parent[i][0], []).append(i)
        built: dict[int, str] = {}
        for i in reversed(order_of):
            below = [bond(i, c, parent[c][1]) + built.pop(c) for c in children.get(i, ())]
            built[i] = atom(i) + marks[i] + "".join(f"({x})" for x in below[:-1]) + (below[-1] if below else "")
        parts.append(built[root])
    return ".".join(parts)
