"""The jobs: crawl run, sync to the external table, import from it, report."""
