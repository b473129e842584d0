"""Connected components, of the library's graph operators."""

from tesserae.operators.graph import connected_components  # noqa: F401
