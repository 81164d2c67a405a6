"""Conversions between models, and the shortest way from one kind to another."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from fractions import Fraction

from ..formats.bpmn import diagram_of_net, diagram_of_powl, diagram_of_tree, write_bpmn
from ..formats.markup import read_pnml, read_ptml, write_pnml, write_ptml
from ..formats.text import FollowsModel
from ..models.automata import Automaton
from ..models.nets import Net, net_of_automaton, net_of_tree
from ..models.powl import net_of_powl, powl_of_tree
from ..models.trees import Tree


def _net_of_model(m: FollowsModel) -> Net:
    """Source, sink and a place per node; arcs bear their target's label, endings are silent."""
    n = len(m.labels)
    net = Net(n + 2, [0] * n + [1, 0])
    for t, w in sorted(m.starts.items()):
        net.add(m.labels[t], [n], [t], w)
    for (s, t), w in sorted(m.edges.items()):
        net.add(m.labels[t], [s], [t], w)
    for s, w in sorted(m.ends.items()):
        net.add(None, [s], [n + 1], w)
    if m.empty > 0:
        net.add(None, [n], [n + 1], m.empty)
    return net


def _unweighted(m: FollowsModel) -> FollowsModel:
    one = lambda d: {k: Fraction(1) for k, w in d.items() if w > 0}
    return FollowsModel(m.labels, one(m.starts), one(m.ends), one(m.edges), Fraction(m.empty > 0))


CONVERSIONS: dict[tuple[str, str], Callable] = {
    ("slang", "lang"): set,
    ("slang", "sdfa"): Automaton.of_language,
    ("lang", "dfa"): lambda x: Automaton.of_language({t: Fraction(1, len(x)) for t in x}).determinise(),
    ("sdfa", "snfa"): lambda x: x,
    ("snfa", "dfa"): Automaton.determinise,
    ("snfa", "slpn"): net_of_automaton,
    ("dfa", "lpn"): net_of_automaton,
    ("dfg", "sdfm"): lambda x: x,
    ("sdfm", "dfm"): _unweighted,
    ("sdfm", "snfa"): FollowsModel.automaton,
    ("sdfm", "slpn"): _net_of_model,
    ("dfm", "dfa"): lambda x: x.automaton().determinise(),
    ("dfm", "lpn"): _net_of_model,
    ("slpn", "lpn"): Net.unweighted,
    ("lpn", "lola"): lambda x: x,
    ("sptree", "ptree"): lambda x: x.weighted([1] * len(x.leaves())),
    ("sptree", "snfa"): Tree.automaton,
    ("ptree", "dfa"): lambda x: x.automaton().determinise(),
    ("ptree", "lpn"): net_of_tree,
    ("ptree", "powl"): powl_of_tree,
    ("powl", "lpn"): net_of_powl,
    ("lpn", "pnml"): write_pnml,
    ("lpn", "diagram"): diagram_of_net,
    ("ptree", "diagram"): diagram_of_tree,
    ("powl", "diagram"): diagram_of_powl,
    ("diagram", "bpmn"): write_bpmn,
    ("diagram", "sbpmn"): lambda x: write_bpmn(x, weights=True),
    ("ptree", "ptml"): write_ptml,
    ("pnml", "lpn"): read_pnml,
    ("ptml", "ptree"): read_ptml,
    ("lola", "lpn"): lambda x: x,
    ("sali", "ali"): lambda x: [(None, m) for _, m in x],
}


def path(source: str, target: str) -> list[str]:
    """The kinds on the shortest way, both ends included; ValueError if there is none."""
    before: dict[str, str | None] = {source: None}
    queue = deque([source])
    while queue:
        now = queue.popleft()
        if now == target:
            out = [now]
            while before[out[-1]] is not None:
                out.append(before[out[-1]])
            return out[::-1]
        for a, b in CONVERSIONS:
            if a == now and b not in before:
                before[b] = now
                queue.append(b)
    raise ValueError(f"no way from {source} to {target}")


def convert(model: object, source: str, target: str) -> object:
    way = path(source, target)
    for a, b in zip(way, way[1:], strict=False):
        model = CONVERSIONS[a, b](model)
    return model
