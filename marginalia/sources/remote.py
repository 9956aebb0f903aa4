"""A data source for literature services, with the offline stand-in as its default.

    spark.dataSource.register(LiteratureSource)
    spark.read.format("literature").option("query", q).option("limit", 5).load()

``fetch`` names an importable function (module:name) from (query, limit) to rows
(paper_id, title, abstract, year).  With the option ``page``, smaller than the limit, it is
called as (query, rows, start) once a page, ``concurrency`` pages at a time, each in a task
on an executor.  Without it, or where a page fails or the first one is empty, the rows are
numbered stand-ins with a warning."""

from __future__ import annotations

from collections.abc import Iterator
from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from marginalia.sources.literature import STAND_IN



class LiteratureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "literature"

    def schema(self) -> str:
        return "paper_id string, title string, abstract string, year int, warning string"

    def reader(self, schema) -> LiteratureReader:
        return LiteratureReader(dict(self.options))


def _dealt(pages: int, options: dict) -> list[InputPartition]:
    """Pages dealt over at most ``concurrency`` tasks: so many requests run at once."""
    tasks = max(1, min(pages, int(options.get("concurrency", 4))))
    return [InputPartition(list(range(i, pages, tasks))) for i in range(tasks)]


class LiteratureReader(DataSourceReader):
    """Pages of ``page`` rows (the whole limit by default) from their own offset; a page that fails has its own warning."""

    def __init__(self, options: dict):
        self.options = options
        self.query, self.limit, self.fetch = options.get("query", ""), int(options.get("limit", 5)), options.get("fetch")
        self.page = max(1, int(options.get("page", self.limit)))

    def partitions(self) -> list[InputPartition]:
        return _dealt(-(-self.limit // self.page), self.options)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if self.query.strip():
            for number in partition.value:
                yield from self._page(number * self.page, min(self.page, self.limit - number * self.page))

    def _page(self, start: int, rows: int) -> Iterator[tuple]:
        warning = "No literature service is set; stand-ins follow."
        if self.fetch:
            module, _, name = self.fetch.partition(":")
            try:
                call = getattr(import_module(module), name)
                found = list(call(self.query, rows, start) if self.page < self.limit else call(self.query, rows))[:rows]
                if found or start:
                    yield from ((*row, None) for row in found)
                    return
                warning = "The literature service found nothing; stand-ins follow."
            except Exception as error:
                warning = f"The literature service failed from row {start + 1} on ({error}); stand-ins follow."
        for n in range(start + 1, start + rows + 1):
            yield f"arxiv-{n}", f"arXiv study on {self.query} #{n}", STAND_IN, 2025, warning


class WorksSource(DataSource):
    """Answers of a works service as JSON texts, for ``literature.openalex_works``.

        spark.read.format("openalex").option("query", q).option("fetch", "module:name").option("key", k).load()
        ... .option("cites", "W1,W2")   # works that cite each of these, one partition an id
        ... .option("pages", 4)         # so many pages of a search, ``concurrency`` at a time

    ``fetch``: an importable function from request parameters (a dict) to the JSON text.  A search without words,
    key or function, or whose request fails, gives one row with a warning; a failed request for citing works gives no row."""

    @classmethod
    def name(cls) -> str:
        return "openalex"

    def schema(self) -> str:
        return "cites string, body string, warning string"

    def reader(self, schema) -> WorksReader:
        return WorksReader(dict(self.options))


class WorksReader(DataSourceReader):
    FIELDS = "id,display_name,publication_year,cited_by_count"
    MOST = 25

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        if "cites" in self.options:
            return [InputPartition(i) for i in self.options["cites"].split(",") if i]
        return _dealt(max(1, int(self.options.get("pages", 1))), self.options)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if isinstance(partition.value, str):
            yield from self._answer(partition.value, 0)
        else:
            for page in partition.value:
                yield from self._answer(None, page)

    def _answer(self, cited: str | None, page: int) -> Iterator[tuple]:
        query, key, fetch = (self.options.get(n, "").strip() for n in ("query", "key", "fetch"))
        lacks = next((n for n, v in (("a query", cited or query), ("a key", key), ("a fetch function", fetch)) if not v), None)
        if lacks:
            yield cited, None, f"The works service needs {lacks}."
            return
        limit = max(1, min(int(self.options.get("limit", 2 if cited else self.MOST)), self.MOST))
        asked = {"filter": f"cites:{cited}", "select": self.FIELDS} if cited else {"search": query, "select": f"{self.FIELDS},referenced_works"}
        if page:
            asked["page"] = str(page + 1)
        module, _, name = fetch.partition(":")
        try:
            yield cited, getattr(import_module(module), name)(asked | {"per-page": str(limit), "sort": "cited_by_count:desc", "api_key": key}), None
        except Exception as error:
            if not cited:
                yield None, None, f"The works service failed on page {page + 1} ({error})."
