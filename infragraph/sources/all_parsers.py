"""Importing this module registers every parser."""

from infragraph.sources import ansible, cloud_templates, compose, kubernetes, terraform  # noqa: F401
