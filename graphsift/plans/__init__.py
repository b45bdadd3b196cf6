"""End-to-end plans: discovery, schema text, XML, mapping rules and RDF."""
