"""Prompts for a remote model, in our own words. Offline judges need none."""

from __future__ import annotations

PAIR_SYSTEM = """You compare short business statements two at a time and decide whether both ask for or report the same thing.
Wording, order and grammar don't matter; a different quantity, period, place or entity does. Say similar only if one could
stand for the other in a report. Give your confidence between 0 and 1 and one sentence of reasoning."""
CLUSTER_SYSTEM = """You check groups of statements that are held to mean the same. Name the members that don't belong with the
others; a group is valid if there are none. Never add members."""
ENTITY_SYSTEM = """You decide for each term whether it names a thing, a concept or a quality of the domain that its contexts
speak of. Fragments, fillers and chance sequences of words are no entities."""
TERM_SYSTEM = """You decide for pairs of terms, given where they occur, whether they name one concept: synonyms, spellings,
singular and plural do; a kind and its sub-kind don't."""
NAME_SYSTEM = """You name a group of terms: a short noun phrase in title case and one sentence that says what they share."""
HIERARCHY_SYSTEM = """You order named topics as a tree, the general above the particular, and give each topic its place once."""


def _context_lines(contexts: list, most: int) -> list[str]:
    return [f"    seen in: {c['sentence'] if isinstance(c, dict) or hasattr(c, 'keys') else c}" for c in list(contexts or [])[:most]]


def pair_prompt(pairs: list[dict]) -> str:
    lines = []
    for p in pairs:
        lines.append(f"Pair {p['pair_id']}\n  A: {p.get('text_a', p.get('id_a'))}\n  B: {p.get('text_b', p.get('id_b'))}")
    return "Judge each of these pairs.\n\n" + "\n".join(lines)


def cluster_prompt(clusters: list[dict]) -> str:
    """clusters: cluster_id and members, (id, text) of each."""
    blocks = ["\n".join([f"Group {c['cluster_id']}", *[f"  {i}: {t}" for i, t in c["members"]]]) for c in clusters]
    return "Check each of these groups.\n\n" + "\n\n".join(blocks)


def entity_prompt(terms: list[dict], contexts: int = 2) -> str:
    return "Which of these terms are entities?\n\n" + "\n".join("\n".join([f"- {t['term']}", *_context_lines(t.get("sample_contexts"), contexts)]) for t in terms)


def term_prompt(pairs: list[dict], contexts: int = 2) -> str:
    blocks = []
    for p in pairs:
        blocks.append("\n".join([f"Pair {p['pair_id']}", f"  A: {p['id_a']}", *_context_lines(p.get("contexts_a"), contexts), f"  B: {p['id_b']}", *_context_lines(p.get("contexts_b"), contexts)]))
    return "Does each pair name one concept?\n\n" + "\n".join(blocks)


def name_prompt(terms: list[str], contexts: list, most_terms: int = 10, most_contexts: int = 3) -> str:
    return "\n".join(["Name what these terms have in common: " + ", ".join(terms[:most_terms]), *_context_lines(contexts, most_contexts)])


def hierarchy_prompt(clusters: list[dict], most: int = 50, most_terms: int = 5) -> str:
    return "Order these topics as a tree.\n\n" + "\n".join(f"- {c['suggested_name']}: {', '.join(c['terms'][:most_terms])}" for c in clusters[:most])
