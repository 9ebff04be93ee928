"""Reading and writing: manual folders, artifacts, snippets."""
