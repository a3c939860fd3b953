"""Similarity of token sequences and of Python code: BLEU with its smoothings, weighted recall, syntax and data flow."""

from __future__ import annotations

import ast
import io
import math
import re
import sys
import tokenize
from collections import Counter
from collections.abc import Callable, Sequence
from functools import lru_cache

#: Programs whose trees and flows a worker remembers.
MEMO = 4096
Pair = tuple[float, float]  # numerator, denominator


def padded(tokens: Sequence, n: int, left=None, right=None) -> list:
    """With n-1 pads at the sides that have one."""
    return [*([left] * (n - 1) if left is not None else []), *tokens, *([right] * (n - 1) if right is not None else [])]


def ngrams(tokens: Sequence, n: int) -> list[tuple]:
    return [tuple(tokens[k : k + n]) for k in range(len(tokens) - n + 1)]


def precision(references: Sequence[Sequence], hypothesis: Sequence, n: int) -> Pair:
    """n-grams of the hypothesis found in a reference, each as often as in the reference that has it most."""
    own = Counter(ngrams(hypothesis, n))
    most: Counter = Counter()
    for r in references:
        most |= Counter(ngrams(r, n))
    return sum((own & most).values()), max(1, sum(own.values()))


def closest_length(references: Sequence[Sequence], length: int) -> int:
    return min((abs(len(r) - length), len(r)) for r in references)[1]


def brevity(reference: int, hypothesis: int) -> float:
    if hypothesis > reference:
        return 1.0
    return math.exp(1 - reference / hypothesis) if hypothesis else 0.0


EPSILON, ALPHA, K = 0.1, 5, 5


def _smooth3(p: list[Pair]) -> list[Pair]:
    zeros, out = 0, []
    for a, b in p:
        zeros += a == 0
        out.append((a, b) if a else (1, 2**zeros * b))
    return out


def _smooth4(p: list[Pair], length: int) -> list[Pair]:
    """Not defined for a single token, which counts as no smoothing."""
    return [(a, b) if a else (k + K / math.log(length), b) if length > 1 else (sys.float_info.min, 1) for k, (a, b) in enumerate(p)]


def _smooth5(p: list[Pair], longer: Pair) -> list[Pair]:
    values = [a / b for a, b in [*p, longer]]
    out, before = [], values[0] + 1
    for k in range(len(p)):
        before = (before + values[k] + values[k + 1]) / 3
        out.append((before, 1))
    return out


def _smooth6(p: list[Pair], hypothesis: Sequence) -> list[Pair]:
    if not p[2][0]:
        raise ValueError("this smoothing needs matches of three tokens")
    out = list(p[:2])
    for k in range(2, len(p)):
        (a2, b2), (a1, b1) = out[k - 2], out[k - 1]
        guess = (a1 / b1) ** 2 / (a2 / b2) if a2 else 0
        out.append((p[k][0] + ALPHA * guess, len(ngrams(hypothesis, k + 1)) + ALPHA))
    return out


def smooth(p: list[Pair], method: int, references: Sequence[Sequence], hypothesis: Sequence, length: int) -> list[Pair]:
    """The eight usual smoothings of n-gram precisions without matches."""
    if method in (4, 7):
        p = _smooth4(p, length)
    if method in (5, 7):
        return _smooth5(p, precision(references, hypothesis, 5))
    simple: dict[int, Callable] = {
        0: lambda: [x if x[0] else (sys.float_info.min, 1) for x in p],
        1: lambda: [x if x[0] else (EPSILON, x[1]) for x in p],
        2: lambda: [(a + 1, b + 1) for a, b in p],
        3: lambda: _smooth3(p),
        4: lambda: p,
        6: lambda: _smooth6(p, hypothesis),
    }
    return simple[method]()


def bleu(pairs: Sequence[tuple[Sequence[Sequence], Sequence]], weights: Sequence[float] = (0.25,) * 4, method: int = 1) -> float:
    """BLEU of (references, hypothesis) pairs taken together; 0 if no token matches."""
    return _score(pairs, weights, method, precision)


def _score(pairs, weights, method, part) -> float:
    p = []
    for n in range(1, len(weights) + 1):
        parts = [part(r, h, n) for r, h in pairs]
        p.append((sum(a for a, _ in parts), sum(b for _, b in parts)))
    if not pairs or not p[0][0]:
        return 0.0
    plain = [[r[0] if isinstance(r, tuple) else r for r in rs] for rs, _ in pairs]
    length = sum(len(h) for _, h in pairs)
    reference = sum(closest_length(r, len(h)) for r, (_, h) in zip(plain, pairs))
    p = smooth(p, method, plain[-1], pairs[-1][1], length)
    return brevity(reference, length) * math.exp(math.fsum(w * math.log(a / b) for w, (a, b) in zip(weights, p)))


def recall(references: Sequence[tuple[Sequence, dict]], hypothesis: Sequence, n: int) -> Pair:
    """n-grams of the (tokens, weights) references found in the hypothesis; single tokens by weight, if all have one."""
    own = Counter(ngrams(hypothesis, n))
    top = bottom = 0.0
    for tokens, weights in references:
        theirs = Counter(ngrams(tokens, n))
        use = n == 1 and len(weights) == len(theirs)
        total = lambda c: sum(k * (weights.get(g[0], 1) if use else 1) for g, k in c.items())  # noqa: B023, E731
        top += total(theirs & own)
        bottom += max(1, total(theirs))
    return top, bottom


def weighted_recall(pairs, weights: Sequence[float] = (0.25,) * 4) -> float:
    return _score([([tuple(r) for r in rs], h) for rs, h in pairs], weights, 1, recall)


# --- code


def without_comments(source: str, language: str) -> str:
    """Comments (in Python also docstrings) and empty lines gone; code that can't be read stays as it is."""
    if language == "python":
        try:
            source = _python_without(source)
        except (tokenize.TokenError, SyntaxError, IndentationError):
            return source
    elif language != "ruby":
        source = re.sub(r"//.*?$|/\*.*?\*/|('(?:\\.|[^\\'])*'|\"(?:\\.|[^\\\"])*\")", lambda m: m[1] or " ", source, flags=re.S | re.M)
    else:
        return source
    return "\n".join(x for x in source.split("\n") if x.strip())


def _python_without(source: str) -> str:
    out, line, col, before = [], -1, 0, tokenize.INDENT
    for t in tokenize.generate_tokens(io.StringIO(source).readline):
        (row, start), (line_end, end) = t.start, t.end
        out.append(" " * max(0, start - (col if row <= line else 0)))
        docstring = t.type == tokenize.STRING and (before in (tokenize.INDENT, tokenize.NEWLINE) or start == 0)
        if t.type != tokenize.COMMENT and not docstring:
            out.append(t.string)
        before, line, col = t.type, line_end, end
    return "".join(out)


def _parts(node: ast.AST) -> list[ast.AST]:
    return [c for c in ast.iter_child_nodes(node) if not isinstance(c, ast.expr_context)]


def _shape(node: ast.AST) -> str:
    """The kinds of nodes of a tree, without names and literals."""
    inner = [_shape(c) for c in _parts(node)]
    return f"({' '.join([type(node).__name__, *inner])})"


def _parse(source: str) -> ast.AST | None:
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _shapes(node: ast.AST, out: list[str]) -> str:
    """The shape of a node; those of it and of all below that have parts go to ``out``."""
    parts = _parts(node)
    shape = f"({' '.join([type(node).__name__, *(_shapes(c, out) for c in parts)])})"
    if parts:
        out.append(shape)
    return shape


@lru_cache(MEMO)
def tree_shapes(source: str) -> tuple[str, ...]:
    """The shapes of all subtrees of Python code, comments aside; none for code that can't be read."""
    root = _parse(without_comments(source, "python"))
    out: list[str] = []
    if root:
        whole = _shapes(root, out)
        out = out or [whole]
    return tuple(out)


def subtrees(source: str) -> list[tuple[str, int, str]]:
    """(shape, depth, code of the first part) of each node with parts, the root and its last branches first."""
    root = _parse(source)
    stack, out = [(root, 1)] if root else [], []
    while stack:
        node, depth = stack.pop()
        parts = _parts(node)
        out.append((_shape(node), depth, ast.unparse(parts[0]) if parts and isinstance(parts[0], (ast.expr, ast.stmt)) else ""))
        stack += [(c, depth + 1) for c in parts if _parts(c)]
    return out


def syntax_match(references: Sequence[str], candidate: str) -> float:
    """Share of the references' subtrees that the candidate has."""
    own = set(tree_shapes(candidate))
    theirs = [s for r in references for s in tree_shapes(r)]
    return sum(s in own for s in theirs) / len(theirs) if theirs else 0.0


def syntax_errors(candidate: str) -> int:
    """0 for code that can be read, -1 for other code."""
    return 0 if _parse(candidate) else -1


Flow = tuple[str, str, tuple[str, ...]]


class _Flows(ast.NodeVisitor):
    """Each name in order: where its value comes from or is computed from. Branches are joined, loops read twice."""

    def __init__(self):
        self.out: list[Flow] = []
        self.known: set[str] = set()

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Load) and node.id in self.known:
            self.out.append((node.id, "comesFrom", (node.id,)))

    def _assign(self, target: ast.AST, value: ast.AST) -> None:
        sources = tuple(n.id for n in ast.walk(value) if isinstance(n, ast.Name))
        for n in ast.walk(target):
            if isinstance(n, ast.Name):
                self.out.append((n.id, "computedFrom", sources))
                self.known.add(n.id)

    def visit_Assign(self, node: ast.Assign) -> None:
        self.visit(node.value)
        for t in node.targets:
            pairs = list(zip(t.elts, node.value.elts)) if isinstance(t, ast.Tuple) and isinstance(node.value, ast.Tuple) and len(t.elts) == len(node.value.elts) else [(t, node.value)]
            for a, b in pairs:
                self._assign(a, b)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if node.value:
            self.visit(node.value)
            self._assign(node.target, node.value)

    def visit_AugAssign(self, node: ast.AugAssign) -> None:
        self.visit(node.value)
        self._assign(node.target, node.value)

    def visit_NamedExpr(self, node: ast.NamedExpr) -> None:
        self.visit(node.value)
        self._assign(node.target, node.value)

    def visit_arg(self, node: ast.arg) -> None:
        self.out.append((node.arg, "comesFrom", ()))
        self.known.add(node.arg)

    def _loop(self, parts: list, head: Callable[[], None]) -> None:
        start = len(self.out)
        for _ in range(2):
            head()
            for s in parts:
                self.visit(s)
        self.out[start:] = dict.fromkeys(self.out[start:])

    def visit_For(self, node: ast.For) -> None:
        self.visit(node.iter)
        self._loop([*node.body, *node.orelse], lambda: self._assign(node.target, node.iter))

    def visit_While(self, node: ast.While) -> None:
        self._loop([*node.body, *node.orelse], lambda: self.visit(node.test))

    def visit_comprehension(self, node: ast.comprehension) -> None:
        self.visit(node.iter)
        self._assign(node.target, node.iter)
        for i in node.ifs:
            self.visit(i)

    def _comprehended(self, node) -> None:
        for g in node.generators:
            self.visit(g)
        for part in ("elt", "key", "value"):
            if hasattr(node, part):
                self.visit(getattr(node, part))

    visit_ListComp = visit_SetComp = visit_DictComp = visit_GeneratorExp = _comprehended


def data_flow(source: str) -> list[Flow]:
    """Edges of the data flow of Python code; none for code that can't be read."""
    root = _parse(without_comments(source, "python"))
    if root is None:
        return []
    v = _Flows()
    v.visit(root)
    return v.out


def normal_flow(flow: list[Flow]) -> list[Flow]:
    """Names replaced by var_0, var_1, ... in the order in which they come up."""
    number: dict[str, str] = {}
    name = lambda x: number.setdefault(x, f"var_{len(number)}")
    return [(kind, tuple(map(name, sources)), name(to)) for to, kind, sources in flow]


@lru_cache(MEMO)
def flow_counts(source: str) -> Counter:
    """How often each edge of the normalised data flow of Python code occurs."""
    return Counter(normal_flow(data_flow(source)))


def flow_match(references: Sequence[str], candidate: str) -> float:
    """Share of the references' data flow that the candidate has, edges counted as often as they occur."""
    own, theirs = flow_counts(candidate), [flow_counts(r) for r in references]
    total = sum(flow.total() for flow in theirs)
    return sum((own & flow).total() for flow in theirs) / total if total else 0.0


# --- programs that call an API


def imports(source: str) -> list[str]:
    """Top-level modules that Python code imports, without the standard library's."""
    root = _parse(source)
    names = set()
    for n in ast.walk(root) if root else ():
        if isinstance(n, ast.Import):
            names.update(a.name for a in n.names)
        elif isinstance(n, ast.ImportFrom) and n.module and not n.level:
            names.add(n.module)
    return sorted({x.split(".")[0] for x in names} - sys.stdlib_module_names)


#: Modules whose package has another name.
PACKAGES = {
    "PIL": "Pillow", "bs4": "beautifulsoup4", "cv2": "opencv-python", "dateutil": "python-dateutil", "dotenv": "python-dotenv", "git": "GitPython",
    "googleapiclient": "google-api-python-client", "jwt": "PyJWT", "OpenSSL": "pyOpenSSL", "psycopg2": "psycopg2-binary", "serial": "pyserial",
    "skimage": "scikit-image", "sklearn": "scikit-learn", "yaml": "PyYAML", "zmq": "pyzmq",
}


def packages(source: str) -> list[str]:
    return sorted((PACKAGES.get(m, m) for m in imports(source)), key=str.lower)


def api_literals(call: str, variant: str = "keywords") -> tuple[str, list[str]] | None:
    """(name, literals that identify the API) of a call in an API table; None if it isn't a call.

    ``keywords``: values of arguments whose text has repo_or_dir or model; ``all``: values of all arguments, by
    keyword or not; ``model``: values of model= and arguments without a keyword.
    """
    root = _parse(call.strip())
    node = root.body[0].value if root and root.body and isinstance(root.body[0], ast.Expr) else None
    if not isinstance(node, ast.Call):
        return None
    text = lambda v: ast.unparse(v).strip("'\"")
    plain = [text(a) for a in node.args]
    named = {
        "keywords": [text(k.value) for k in node.keywords if re.search("repo_or_dir|model", ast.unparse(k))],
        "all": [*plain, *(text(k.value) for k in node.keywords)],
        "model": [*plain, *(text(k.value) for k in node.keywords if k.arg == "model")],
    }[variant]
    return ast.unparse(node.func), named


def api_index(candidate: str, table: Sequence[tuple[str, list[str]] | None]) -> int:
    """Number of the first API whose literals all stand in the call of that name (or, without one, in the last part); -1."""
    root = _parse(candidate.strip())
    stack, parts = [root] if root else [], []
    while stack:
        node = stack.pop()
        if not isinstance(node, (ast.Load, ast.Store)):
            parts.append(node)
        stack += [c for c in ast.iter_child_nodes(node) if any(True for _ in ast.iter_child_nodes(c))]
    code = [(ast.unparse(p.func) if isinstance(p, ast.Call) else "", ast.unparse(p) if isinstance(p, (ast.expr, ast.stmt, ast.mod)) else "") for p in parts]
    for k, api in enumerate(table):
        if api is None or not api[1] or not code:
            continue
        where = next((c for n, c in code if n == api[0]), code[-1][1])
        if all(x in where.replace('"', "'") for x in api[1]):
            return k
    return -1
