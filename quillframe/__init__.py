"""quillframe: document, spreadsheet and corpus analytics on PySpark DataFrames."""
