"""Written tables of the operators of this subpackage."""

from tessera.sources.workspace import Workspace

__all__ = ["Workspace"]
