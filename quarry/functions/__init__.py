"""Column functions: text analysis, access labels, vectors. All of them stay in the JVM but NFC."""
