"""Row-generating operations on structures: each turns one structure into many, in Arrow batches."""

from framelake.generators import alloys, cells, datasets, magnetism, molecules  # noqa: F401 - registers the operations
from framelake.generators.base import OPERATIONS, apply, branches, generate, load_plugins, operation, pipeline, run_one  # noqa: F401
