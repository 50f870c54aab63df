"""Writers of reports: JSON, text, Markdown, SARIF, OpenAPI, HTML."""
