"""Graph operators: what each takes and gives, and how it becomes columns."""

from quantloom.operators.spec import OpRegistry, OpSpec, compact_registry, full_registry

__all__ = ["OpRegistry", "OpSpec", "compact_registry", "full_registry"]
