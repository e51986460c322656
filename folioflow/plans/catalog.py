"""All queries of the core."""

from . import books, layouts, runs, stores


def register_all() -> None:
    books.register_all()
    layouts.register_all()
    stores.register_all()
    runs.register_all()
