"""Every error the library raises on purpose."""


class SluiceError(Exception):
    """Base of the library's errors."""


class TableError(SluiceError):
    """A table definition is not valid."""


class TableNotFound(SluiceError):
    """No table of that name is registered."""


class TableExists(SluiceError):
    """A table of that name is registered already."""


class SubscriptionNotFound(SluiceError):
    """The table has no such source."""


class SchemaMismatch(SluiceError):
    """Columns or types differ from what was declared or stored."""


class ColumnNotFound(SluiceError):
    """A column is missing."""


class MultipleColumnsFound(SluiceError):
    """A column name is not unique."""


class PartitionError(SluiceError):
    """A partition strategy or its options are not valid."""


class NullKey(SluiceError):
    """A key column holds null."""


class DuplicateKeys(SluiceError):
    """A batch holds a key twice."""


class UnprocessedKeys(SluiceError):
    """A batch holds a key that is not among the processed keys."""


class ManifestNotFound(SluiceError):
    """A partition has no manifest."""


class ManifestError(SluiceError):
    """A manifest's content is not valid."""


class CommitConflict(SluiceError):
    """Another writer published the same version first."""


class EmptyBatch(SluiceError):
    """A partition has nothing staged."""


class QueueError(SluiceError):
    """A queue or task is unknown, or does not support the operation."""
