"""What can go wrong, by kind."""

from __future__ import annotations


class LakefindError(Exception):
    """Any error of this library."""


class IndexNotFound(LakefindError):
    """No index has this name."""


class IndexExists(LakefindError):
    """An index of this name is there already."""


class SchemaError(LakefindError):
    """A schema or a field's use does not fit."""


class QueryParseError(LakefindError):
    """A query string, a query tree or an aggregation request cannot be read."""


class DocumentError(LakefindError):
    """A document does not fit the schema; the message names the field."""


class DocumentNotFound(LakefindError):
    """No document has this id."""


class TableError(LakefindError):
    """A versioned table cannot be read or written."""


class WriterLocked(TableError):
    """Another writer committed first or holds the lock."""


class IngestError(LakefindError):
    """A file to ingest is missing, empty, or of an unknown format."""
