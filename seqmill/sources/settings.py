"""Parameters of a retrieval: presets, checks, and requests built from them."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, fields

#: Defaults of a search request.
DEFAULTS = {"program": "blastn", "database": "nt", "expect": 10.0, "gap_costs": "2 1", "alignments": 1000, "word_size": 7, "reward": 1, "penalty": -1}


@dataclass(frozen=True)
class Retrieval:
    """Settings of one marker; lists are packed with ``|`` in files."""

    target_region: str
    key_annotations: tuple[str, ...]
    exclude_sources: tuple[str, ...] = ()
    entrez_qualifier: str = ""
    max_length: int = 800
    expect_value: float = 10.0
    gap_costs: str = "2 1"
    word_size: int = 7
    nucl_reward: int = 1
    nucl_penalty: int = -1
    ref_number: int = 5


def from_parameters(values: Mapping[str, str]) -> Retrieval:
    """Settings from a parameter file's map; unknown keys are ignored."""
    kinds = {f.name: f.type for f in fields(Retrieval)}
    out: dict[str, object] = {}
    for k, v in values.items():
        kind = kinds.get(k)
        if kind is None or not v.strip():
            continue
        if kind.startswith("tuple"):
            out[k] = tuple(x.strip() for x in v.split("|") if x.strip())
        else:
            out[k] = {"int": int, "float": float, "str": str}[kind](v)
    return Retrieval(**{"target_region": "", "key_annotations": ()} | out)


def problems(r: Retrieval) -> list[str]:
    """What is wrong with the settings, in words; empty if nothing is."""
    out = []
    if not r.target_region:
        out.append("the target region is missing")
    if not r.key_annotations:
        out.append("key annotations are missing")
    if r.max_length <= 0 or r.word_size <= 0 or r.ref_number <= 0:
        out.append("lengths and numbers must be positive")
    if r.expect_value <= 0:
        out.append("the expect value must be positive")
    if r.nucl_reward <= 0 or r.nucl_penalty >= 0:
        out.append("the reward must be positive and the penalty negative")
    costs = r.gap_costs.split()
    if len(costs) != 2 or not all(c.lstrip("-").isdigit() for c in costs):
        out.append("gap costs are two whole numbers")
    return out


def put_request(sequence: str, r: Retrieval, expected: int | None = None, query: str | None = None) -> dict[str, str]:
    """Fields of a search request; those without a value are left out."""
    values = {
        "CMD": "Put", "PROGRAM": DEFAULTS["program"], "DATABASE": DEFAULTS["database"], "QUERY": sequence, "EXPECT": r.expect_value, "GAPCOSTS": r.gap_costs,
        "WORD_SIZE": r.word_size, "NUCL_REWARD": r.nucl_reward, "NUCL_PENALTY": r.nucl_penalty, "ENTREZ_QUERY": query,
        "HITLIST_SIZE": hits_wanted(expected) if expected else DEFAULTS["alignments"], "ALIGNMENTS": DEFAULTS["alignments"],
    }
    return {k: str(v) for k, v in values.items() if v is not None}


def hits_wanted(expected: int) -> int:
    return math.ceil(1.05 * expected)
