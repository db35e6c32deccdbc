from kinweave.plans.linking import ColumnRule, RecordLinker

__all__ = ["ColumnRule", "RecordLinker"]
