"""The equivalent SQL of the queries that SQL can express."""

SQL: dict[str, str] = {
    "p5_found": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, t.row_id FROM {t} t, size_limits s WHERE s.table_name = '{t}' AND s.field_name = 'text' AND length(t.text) > s.max_size"
        for t in ("nodes", "text_chunks", "document_chunks")
    ),
    "p4_clean_files": """
        SELECT * FROM legal_files
        WHERE access_status IS NULL OR trim(access_status, E' \\t\\r\\n') IN ('', 'public', 'subscribed', 'paywalled', 'unauthorized', 'missing_file')""",
}
