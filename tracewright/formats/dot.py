"""Drawings of models as DOT text and as SVG."""

from __future__ import annotations

from collections import deque
from xml.sax.saxutils import escape

from ..models.automata import Automaton
from ..models.nets import Net
from ..models.powl import END, START, Powl
from ..models.trees import Node, Tree
from .bpmn import Diagram
from .text import FollowsModel, PartialTrace


def _text(label: object) -> str:
    return str(label).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")


Drawn = tuple[list[tuple[object, str, object]], list[tuple[object, object, object]]]


def dot(model: object) -> str:
    """Any model: graphs and models of follows, automata, nets, trees, partial orders, partially ordered traces, diagrams."""
    nodes, edges = drawn(model)
    rows = [f'  "{_text(i)}" [shape={shape}, label="{_text(label)}"];' for i, shape, label in nodes]
    rows += [f'  "{_text(s)}" -> "{_text(t)}" [label="{_text(label)}"];' for s, t, label in edges]
    return "\n".join(["digraph {", "  rankdir=LR;", *rows, "}"])


def svg(model: object) -> str:
    """The same drawing as an SVG image: columns by the distance from where nothing leads to, boxes and circles, straight lines."""
    nodes, edges = drawn(model)
    into = {t for s, t, _ in edges if s != t}
    follow: dict[object, list[object]] = {}
    for s, t, _ in edges:
        follow.setdefault(s, []).append(t)
    column: dict[object, int] = {}
    for begin in [*(i for i, _, _ in nodes if i not in into), *(i for i, _, _ in nodes)]:
        todo = deque([(begin, 0)] if begin not in column else [])
        while todo:
            at, depth = todo.popleft()
            if at not in column:
                column[at] = depth
                todo.extend((t, depth + 1) for t in follow.get(at, ()))
    used: dict[int, int] = {}
    place = {}
    for i, _, _ in nodes:
        used[column[i]] = used.get(column[i], 0) + 1
        place[i] = 90 + 150 * column[i], 20 + 60 * used[column[i]]
    out = ['<defs><marker id="a" viewBox="0 0 8 8" refX="8" refY="4" markerWidth="6" markerHeight="6" orient="auto"><path d="M0 0L8 4L0 8z"/></marker></defs>']
    for s, t, label in edges:
        (x, y), (u, v) = place[s], place[t]
        way = f"M{x + 10} {y - 16}c30 -40 -50 -40 -20 0" if s == t else f"M{x + (45 if u > x else -45 if u < x else 0)} {y + (0 if u != x else 16 if v > y else -16)}L{u - (45 if u > x else -45 if u < x else 0)} {v - (0 if u != x else 16 if v > y else -16)}"
        out.append(f'<path d="{way}" fill="none" stroke="black" marker-end="url(#a)"/><text x="{(x + u) // 2}" y="{(y + v) // 2 - 5}">{escape(str(label))}</text>')
    for i, shape, label in nodes:
        x, y = place[i]
        if shape in ("circle", "doublecircle", "point", "ellipse"):
            body = f'<ellipse cx="{x}" cy="{y}" rx="{40 if shape == "ellipse" else 16}" ry="16" fill="white" stroke="black" stroke-width="{3 if shape == "doublecircle" else 1}"/>'
        else:
            body = f'<rect x="{x - 45}" y="{y - 16}" width="90" height="32" rx="{8 if shape == "diamond" else 0}" fill="white" stroke="black"/>'
        out.append(f'{body}<text x="{x}" y="{y + 4}">{escape(str(label))}</text>')
    size = max((x for x, _ in place.values()), default=0) + 90, max((y for _, y in place.values()), default=0) + 60
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{size[0]}" height="{size[1]}" font-size="11" text-anchor="middle">{"".join(out)}</svg>'


def drawn(model: object) -> Drawn:
    """Nodes (name, shape, label) and edges (source, target, label) of a model."""
    if isinstance(model, Automaton):
        nodes = [(s, "doublecircle" if s in model.final else "circle", s) for s in range(model.states)]
        return (nodes, [(s, t, f"{'' if x is None else x} {p}".strip()) for (s, x, t), p in model.arcs.items()])
    if isinstance(model, Net):
        nodes = [(f"p{p}", "circle", "" if not model.marking or not model.marking[p] else model.marking[p]) for p in range(model.places)]
        edges = []
        for i, t in enumerate(model.transitions):
            nodes.append((f"t{i}", "box", t.label or ""))
            edges += [(f"p{p}", f"t{i}", k if k > 1 else "") for p, k in t.inputs.items()] + [(f"t{i}", f"p{p}", k if k > 1 else "") for p, k in t.outputs.items()]
        return (nodes, edges)
    if isinstance(model, FollowsModel):
        nodes = [("start", "circle", ""), ("end", "doublecircle", ""), *((i, "box", x) for i, x in enumerate(model.labels))]
        edges = [("start", i, w) for i, w in model.starts.items()] + [(s, t, w) for (s, t), w in model.edges.items()] + [(i, "end", w) for i, w in model.ends.items()]
        return (nodes, edges + ([("start", "end", model.empty)] if model.empty else []))
    if isinstance(model, Tree):
        nodes, edges = [], []

        def node(n: Node) -> int:
            i = len(nodes)
            nodes.append((i, "ellipse" if n.children else "box", n.kind if n.children else n.label or ""))
            edges.extend([(i, node(c), "") for c in n.children])
            return i

        if model.root:
            node(model.root)
        return (nodes, edges)
    if isinstance(model, Powl):
        nodes, edges = [], []

        def of(n: Powl, name: str) -> str:
            marks = ("?" if n.skippable else "") + ("*" if n.repeatable else "")
            nodes.append((name, "box" if n.kind == "activity" else "component", (n.label or "" if n.kind == "activity" else n.kind) + marks))
            names = {i: of(c, f"{name}.{i}") for i, c in enumerate(n.children)}
            ends = {START: f"{name}.start", END: f"{name}.end"}
            if n.kind == "choice_graph":
                nodes.extend([(x, "point", "") for x in ends.values()])
            edges.extend([((names | ends)[s], (names | ends)[t], "") for s, t in sorted(n.edges)])
            return name

        of(model, "n")
        return (nodes, edges)
    if isinstance(model, Diagram):
        shape = {"task": "box", "start": "circle", "end": "doublecircle", "event": "circle"}
        sign = {"exclusive": "x", "parallel": "+", "inclusive": "o"}
        return ([(i, shape.get(kind, "diamond"), label or sign.get(kind, "")) for i, (_, kind, label) in model.elements.items()], [(s, t, "" if w is None else w) for s, t, w in model.flows])
    if isinstance(model, list) and all(isinstance(t, PartialTrace) for t in model):
        nodes, edges = [], []
        for k, trace in enumerate(model):
            nodes += [(f"{k}.{i}", "box", label) for i, (label, _) in enumerate(trace.events)]
            edges += [(f"{k}.{j}", f"{k}.{i}", "") for i, (_, before) in enumerate(trace.events) for j in before]
        return (nodes, edges)
    raise ValueError(f"no drawing of {type(model).__name__}")
