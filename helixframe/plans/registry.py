"""Operators by domain and number."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import partial
from typing import Any

from helixframe.operators import composition, correlation, embedding, kernels, similarity


@dataclass(frozen=True)
class Operator:
    number: int
    name: str
    run: Callable[..., Any]

    @property
    def parameters(self) -> tuple[str, ...]:
        return tuple(inspect.signature(self.run).parameters)


def _operators(*entries: tuple[int, str, Callable[..., Any]]) -> dict[int, Operator]:
    return {n: Operator(n, name, run) for n, name, run in entries}


#: Numbers are the published interface.
DOMAINS: dict[str, dict[int, Operator]] = {
    "rna": _operators(
        (1, "kmer", composition.kmer),
        (2, "canonical kmer", composition.canonical_kmer),
        (3, "pseudo dinucleotide composition", correlation.pse_dnc),
        (4, "dinucleotide auto covariance", correlation.auto_covariance),
        (5, "dinucleotide cross covariance", correlation.cross_covariance),
        (6, "dinucleotide auto and cross covariance", correlation.auto_cross_covariance),
        (7, "mononucleotide composition", composition.mono_composition),
        (8, "dinucleotide composition", composition.di_composition),
        (9, "trinucleotide composition", composition.tri_composition),
        (10, "z-curve", composition.zcurve),
        (11, "mono-mono gap", composition.mono_mono_gap),
        (12, "mono-di gap", composition.mono_di_gap),
    ),
    "disease": _operators(
        (13, "term similarity", similarity.pair_similarity),
        (14, "disease similarity", similarity.disease_similarity),
        (15, "lncRNA functional similarity", similarity.functional_similarity),
    ),
    "cross": _operators(
        (16, "interaction profile kernels", kernels.interaction_profiles),
        (17, "singular value features", kernels.svd_features),
    ),
    "nn": _operators(
        (100, "sequence embeddings, first backbone", partial(embedding.sequence_embeddings, batch_size=16)),
        (101, "token embeddings, first backbone", partial(embedding.token_embeddings, batch_size=8)),
        (103, "sequence embeddings, second backbone", partial(embedding.sequence_embeddings, batch_size=8)),
        (104, "token embeddings, second backbone", partial(embedding.token_embeddings, batch_size=4)),
        (130, "chunked embeddings, first backbone", partial(embedding.chunked_embeddings, batch_size=8)),
        (131, "chunked embeddings, second backbone", partial(embedding.chunked_embeddings, batch_size=4)),
    ),
}


def list_domains() -> list[str]:
    return sorted(DOMAINS)


def domain(name: str) -> dict[int, Operator]:
    try:
        return DOMAINS[name.lower()]
    except KeyError:
        raise ValueError(f"no domain {name!r}; known: {', '.join(list_domains())}") from None


def has_method(name: str, number: int) -> bool:
    return number in domain(name)


def ensure_methods(name: str, numbers: Iterable[int]) -> None:
    unknown = sorted(set(numbers) - set(domain(name)))
    if unknown:
        raise ValueError(f"{name} has no methods {unknown[:10]}; it has {sorted(domain(name))}")


def describe(name: str) -> str:
    return "\n".join(f"{o.number}: {o.name} ({', '.join(o.parameters)})" for _, o in sorted(domain(name).items()))


def run(name: str, number: int, *tables: Any, **parameters: Any) -> Any:
    """Run an operator; parameters that it lacks are an error."""
    ensure_methods(name, [number])
    return domain(name)[number].run(*tables, **parameters)


def accepted(name: str, number: int, parameters: dict[str, Any]) -> dict[str, Any]:
    """Of ``parameters``, those that the operator takes and that are given."""
    ensure_methods(name, [number])
    return {k: v for k, v in parameters.items() if v is not None and k in domain(name)[number].parameters}
