"""Sheet cells to a costed table."""

from billwright import rules
from billwright.operators import costing, sheets
from billwright.operators.settle import settle


def structure(cells, cell_images=None, drop_repeated=True, keep_images=True, whole=False):
    """Header and table of each document. The gathered rows are written once and read by both.

    ``whole`` says that every document fits a task; its rows then stay together and are not written.
    """
    rows = sheets.sheet_rows(cells, cell_images)
    if whole:
        return sheets.stitch_whole(rows, drop_repeated, keep_images)
    rows = settle(rows, "rows")
    return sheets.stitch(rows, sheets.header_rows(rows), drop_repeated, keep_images)


def summary_of_cells(cells, whole=False):
    """Summary of each original table (A1); its rows need no numbers."""
    if whole:
        header, table = structure(cells, whole=True)
        return costing.extracted_summary(sheets.with_roles(table, header, rules.VIEWER_ROLES))
    rows = settle(sheets.sheet_rows(cells), "rows")
    headers = sheets.header_rows(rows)
    body = sheets.data_rows(rows, headers)
    return costing.extracted_summary(body, sheets.column_roles(sheets.document_header(headers, body), rules.VIEWER_ROLES))


def cost_documents(cells, factors, cell_images=None, whole=False):
    """Summary of the original table, costed line items and totals per document."""
    header, table = structure(cells, cell_images, whole=whole)
    offered = sheets.with_roles(table, header, rules.OFFER_ROLES, default_description=2, money=True)
    items = sheets.boq_rows(costing.cost_table(offered, None, factors))
    return {
        "summary": costing.extracted_summary(sheets.with_roles(table, header, rules.VIEWER_ROLES)),
        "items": items,
        "totals": costing.totals(items, factors),
    }
