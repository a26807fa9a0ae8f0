"""Training-data operators: tokenisation, curation scans, sketches and archives.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
only where the folder is present.
"""
