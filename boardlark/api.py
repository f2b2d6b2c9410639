"""What a caller asks: pages of notices with facets, one notice, answers, over a published store."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame

from boardlark.operators import rag, search
from boardlark.operators.search import Filters
from boardlark.operators.store import Store
from boardlark.rules import UNIVERSITY, Taxonomy


def number(text: object, default: int) -> int:
    """A whole number from a request, or the default."""
    try:
        return int(str(text).strip())
    except ValueError:
        return default


@dataclass(frozen=True)
class Listing:
    items: list[dict]
    total: int
    page: int
    page_size: int
    total_pages: int
    facets: dict[str, list[str]]
    effective_source_group: str | None


class Notices:
    """Reads one store.  mode: `primary` or `fallback` search semantics."""

    def __init__(self, store: Store, taxonomy: Taxonomy = UNIVERSITY, mode: str = "primary", model: rag.LanguageModel | None = None):
        self.store, self.taxonomy, self.mode, self.model = store, taxonomy, mode, model

    def _narrowed(self, filters: Filters) -> tuple[DataFrame, dict, str | None]:
        audience, wanted = search.value_or_none(filters.audience), search.value_or_none(filters.source_group)
        facets, group = self.store.facets(audience, wanted, self.taxonomy)
        if audience not in self.taxonomy.source_filter_audiences:
            facets = facets | {"sources": []}
        return search.filtered(self.store.notices(), filters, facets["source_groups"], self.taxonomy, self.mode == "fallback"), facets, group

    def page(self, q: str | None = None, filters: Filters | None = None, page: object = 1, page_size: object = None, today: date | None = None) -> Listing:
        """One page; numbers that can't be read fall back to the defaults."""
        rows, facets, group = self._narrowed(filters or Filters())
        size = None if page_size is None else number(page_size, 20)
        found = search.search(rows, q, number(page, 1), size, today, self.mode)
        return Listing([r.asDict(True) for r in found.items.collect()], found.total, found.page, found.size, found.pages, facets, group)

    def one(self, notice_id: str) -> dict | None:
        row = self.store.by_id(notice_id).first()
        return row.asDict(True) if row else None

    def ask(self, question: str, **options) -> rag.Answer:
        return rag.ask(self.store.notices(), question, model=self.model, **options)

    def stream(self, question: str, **options) -> Iterator[tuple[str, object]]:
        return rag.stream(self.store.notices(), question, model=self.model, **options)
