"""All registered queries of the engine; importing the catalogs registers them."""

from discloq import catalog, catalog_reports  # noqa: F401

QUERIES, SQL = catalog.QUERIES, catalog.SQL
