"""Prompt building as string columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketloom.functions import constants as K


def fill_template(template: str, **values: Column) -> Column:
    """Replace each ``{name}`` in the template by a column."""
    pieces, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        pieces += [F.lit(before), values[name]]
    return F.concat(*pieces, F.lit(rest))


def build_prompt(ticket: Column, context: Column, categories: Sequence[str]) -> Column:
    """Classification prompt with a ``- name`` line per category."""
    listing = F.lit("\n".join(f"- {c}" for c in categories))
    return fill_template(
        K.CLASSIFICATION_TEMPLATE, ticket_content=ticket, context=context, categories=listing
    )


def build_answer_prompt(context: Column, question: Column) -> Column:
    """Question answering prompt."""
    return fill_template(K.RAG_TEMPLATE, context=context, question=question)


def prompt_for(kind: str, **values) -> Column:
    """Dispatch by template type: ``classification`` or ``rag``."""
    if kind == "classification":
        return build_prompt(values["ticket"], values["context"], values["categories"])
    if kind == "rag":
        return build_answer_prompt(values["context"], values["question"])
    raise ValueError(f"unknown template type: {kind}")
