"""Sentences in other words than the training texts, in four languages: what each of them holds."""

HELD_OUT = [
    ("My social is 219-09-9999 and I regret telling them.", [("idnum", "219-09-9999")]),
    ("His SSN was leaked as 219-09-9998 last week.", [("idnum", "219-09-9998")]),
    ("Insurance card AB123456C was found in the hall.", [("idnum", "AB123456C")]),
    ("We live at 48 Harcourt Gardens now.", [("address", "48 Harcourt Gardens")]),
    ("My colleague Priya Raghunathan wrote most of this.", [("name", "Priya Raghunathan")]),
    ("Send parcels to 7 Elm Grove, Norwich please", [("address", "7 Elm Grove, Norwich")]),
    ("You may text +44 7700 900461 after six.", [("phone", "+44 7700 900461")]),
    ("Questions go to j.harper@post.example before Friday.", [("email", "j.harper@post.example")]),
    ("Mrs. Olive Thornbury answered at once.", [("name", "Olive Thornbury")]),
    ("Dial (212) 555-0147 for the desk.", [("phone", "(212) 555-0147")]),
    ("mail bob [at] shop [dot] example about it", [("email", "bob [at] shop [dot] example")]),
    ("the parcel went to 221b Baker Street yesterday", [("address", "221b Baker Street")]),
    ("Meine Steuernummer lautet 12/345/67890.", [("idnum", "12/345/67890")]),
    ("Unsere Anschrift: Lindenallee 14, 50667 Köln", [("address", "Lindenallee 14, 50667 Köln")]),
    ("Mein Nachbar Jürgen Pfeiffer sagte nichts dazu.", [("name", "Jürgen Pfeiffer")]),
    ("Ruf mich an: 0151 23456789, abends.", [("phone", "0151 23456789")]),
    ("Schreib an k.vogel@brief.example, danke.", [("email", "k.vogel@brief.example")]),
    ("Frau Heike Brandt wohnt im Rosenweg 5.", [("name", "Heike Brandt"), ("address", "Rosenweg 5")]),
    ("Sein Reisepass ZZ7654321 ist abgelaufen.", [("idnum", "ZZ7654321")]),
    ("Je m'appelle Solange Petitjean et je corrige.", [('name', 'Solange Petitjean')]),
    ("Elle demeure 16 route de Vannes depuis peu.", [("address", "16 route de Vannes")]),
    ("Téléphone : 06 12 34 56 78, le soir.", [("phone", "06 12 34 56 78")]),
    ("Contactez-moi à l.morel@courrier.example", [("email", "l.morel@courrier.example")]),
    ("Numéro de sécurité sociale 2 85 05 78 006 084 36", [("idnum", "2 85 05 78 006 084 36")]),
    ("Monsieur Gaston Lefèvre habite 3, allée des Tilleuls.", [("name", "Gaston Lefèvre"), ("address", "3, allée des Tilleuls")]),
    ("Me llamo Ramiro Castañeda, encantado.", [("name", "Ramiro Castañeda")]),
    ("Su DNI es 12345678Z según la ficha.", [("idnum", "12345678Z")]),
    ("Envíe la carta a Calle Mayor 12, 28013 Madrid", [("address", "Calle Mayor 12, 28013 Madrid")]),
    ("Mi móvil: +34 612 34 56 78", [("phone", "+34 612 34 56 78")]),
    ("El correo es p.nunez@carta.example", [("email", "p.nunez@carta.example")]),
    ("La señora Pilar Echeverría vive en Ronda de Toledo 9.", [("name", "Pilar Echeverría"), ("address", "Ronda de Toledo 9")]),
    ('Reach Theodore Blackwood on his cell, 617-555-0133.', [('name', 'Theodore Blackwood'), ('phone', '617-555-0133')]),
    ('Her taxpayer id 900-12-3456 is printed below.', [('idnum', '900-12-3456')]),
    ('The keys are at 5 Maple Crescent.', [('address', '5 Maple Crescent')]),
    ('According to my sister Ingrid Solheim, nothing changed.', [('name', 'Ingrid Solheim')]),
    ('Drop a line to wanda_k@letters.example sometime.', [('email', 'wanda_k@letters.example')]),
    ('They rent Unit 4, 90 Orchard Road since May.', [('address', 'Unit 4, 90 Orchard Road')]),
    ('Der Ausweis L01X00T471 lag auf dem Tisch.', [('idnum', 'L01X00T471')]),
    ('Fragen an Herrn Otto Wiesner, Telefon 030 901820.', [('name', 'Otto Wiesner'), ('phone', '030 901820')]),
    ('Wir ziehen in die Gartenstraße 22.', [('address', 'Gartenstraße 22')]),
    ('Mailadresse: m.krause@post.example', [('email', 'm.krause@post.example')]),
    ('Mon amie Claire Dubois travaille ici.', [('name', 'Claire Dubois')]),
    ('Joindre le secrétariat au 01 44 55 66 77.', [('phone', '01 44 55 66 77')]),
    ('Son passeport ZZ1230987 a été retrouvé.', [('idnum', 'ZZ1230987')]),
    ('Le colis part au 27 quai Voltaire, merci.', [('address', '27 quai Voltaire')]),
    ('Écrivez donc à jean.paul@poste.example !', [('email', 'jean.paul@poste.example')]),
    ('El señor Julián Ortega trabaja aquí.', [('name', 'Julián Ortega')]),
    ('Vivimos en la Avenida Libertad 45.', [('address', 'Avenida Libertad 45')]),
    ('Su pasaporte ZZ5556667 caducó.', [('idnum', 'ZZ5556667')]),
    ('Llame al 91 234 56 78 por la mañana.', [('phone', '91 234 56 78')]),
    ('Mándalo a s.gil@correo.example hoy.', [('email', 's.gil@correo.example')]),
]
#: Sentences without any item.
PLAIN = [
    'In 1999 Park Street was the longest street of the town.',
    'The Harcourt Gardens were laid out in 1820.',
    'Order 123456789 was shipped with ISBN 978-1-4028-9462-6.',
    'Version 10.15.7 came after 10.14.6.',
    'Newton Bridge is a bridge over the River Ouse.',
    'Die Allee 1 und die Allee 2 sind Alleen.',
    'La plaza Mayor es grande.',
    'Rosa Parks Avenue crosses Main Street.',
    'The 12 Angry Men Way of doing things.',
    'Contig 8845120 maps to locus 77.',
    'Lot 555012 of 4.5.2011',
    'Le boulevard Voltaire a été ouvert en 1857.',
    'Call the police at once.',
    'The Turing–Church thesis',
    'Ask for Directions in 30 Days',
]
