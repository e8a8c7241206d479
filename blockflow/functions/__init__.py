"""Column-level functions: ids and text, numbers, hashing uniforms, geometry."""

from . import geo, ids, numeric, rand  # noqa: F401
