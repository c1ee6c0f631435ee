"""Web-page processing on Spark: captured pages in, document, link and vector tables out."""
