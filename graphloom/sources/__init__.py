"""Reading tables and mapping them onto the model: events, triples, nested documents."""
