"""Errors raised by setup, publishing and ingestion."""


class DatabaseMissing(RuntimeError):
    """A table was asked for before its database exists."""

    def __init__(self, database: str):
        super().__init__(f"database {database!r} does not exist; run setup first")
        self.database = database


class CursorMissing(LookupError):
    """A cursor row was expected and is not there."""

    def __init__(self, name: str):
        super().__init__(f"no cursor named {name!r}")
        self.name = name


class CheckpointLost(RuntimeError):
    """A bronze table holds batches but its stream checkpoint is gone."""

    def __init__(self, table: str, checkpoint: str):
        super().__init__(
            f"{table} already holds batches but {checkpoint} has no offsets: batch numbers "
            "would restart at 0 and overwrite them"
        )
        self.table = table


class TableLost(RuntimeError):
    """A stream checkpoint has committed batches but its bronze table holds none."""

    def __init__(self, table: str, checkpoint: str):
        super().__init__(
            f"{checkpoint} has committed batches but {table} holds none: its files would not be "
            "read again; recover the table's partitions or start a fresh checkpoint"
        )
        self.table = table


class NotNullViolated(ValueError):
    """Rows about to be published hold nulls in a column that must not have any."""

    def __init__(self, table: str, column: str, count: int):
        super().__init__(f"{count} rows for {table} have no {column}; the table keeps its previous contents")
        self.table, self.column, self.count = table, column, count
