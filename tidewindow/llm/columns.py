"""Keeping a table's own columns apart from those that an operator makes."""

from functools import wraps

USED = ("doc_id", "text", "lang", "source")


def columns_kept(operator):
    """An operator from documents to documents that neither meets nor changes their other columns,
    whatever their names: it sees them numbered, and they get their names back."""

    @wraps(operator)
    def run(docs, *args, **kwargs):
        plain = docs.toDF(*[c if c in USED else f"other{i}" for i, c in enumerate(docs.columns)])
        return operator(plain, *args, **kwargs).toDF(*docs.columns)

    return run
