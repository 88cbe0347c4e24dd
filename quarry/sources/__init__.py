"""Connectors: descriptors, files, Git trees, web pages and e-books, each as a DataFrame of items or documents."""
