"""Names and cities that are known without settings: an own choice of the commonest ones by public statistics of German and English
speaking countries. It isn't meant to be complete; files of terms in the settings (``word_lists``) replace it."""

FIRST_NAMES = [
    "Alexander", "Andrea", "Andreas", "Angela", "Anja", "Anna", "Anne", "Barbara", "Ben", "Bernd", "Birgit", "Brigitte", "Carla", "Christian", "Christina",
    "Christine", "Claudia", "Daniel", "Daniela", "David", "Dennis", "Dieter", "Elena", "Elisabeth", "Emily", "Emma", "Erik", "Eva", "Felix", "Finn", "Florian",
    "Frank", "Franziska", "Gabriele", "Georg", "Gerhard", "Hans", "Heike", "Heinz", "Helga", "Helmut", "Holger", "Ingrid", "Jakob", "James", "Jan", "Jana",
    "Jennifer", "Jens", "Joachim", "Johanna", "Johannes", "John", "Jonas", "Julia", "Karin", "Karl", "Katharina", "Kathrin", "Katja", "Klaus", "Lars", "Laura",
    "Lea", "Lena", "Leon", "Lina", "Linda", "Lisa", "Luca", "Lukas", "Manfred", "Manuela", "Maria", "Marie", "Marion", "Markus", "Martin", "Martina", "Mary",
    "Matthias", "Max", "Maximilian", "Melanie", "Mia", "Michael", "Michelle", "Monika", "Moritz", "Nadine", "Nicole", "Nina", "Noah", "Olaf", "Oliver",
    "Patricia", "Patrick", "Paul", "Peter", "Petra", "Philipp", "Rainer", "Ralf", "Renate", "Robert", "Sabine", "Sabrina", "Sandra", "Sara", "Sarah",
    "Sebastian", "Silke", "Simone", "Sophie", "Stefan", "Stefanie", "Stephan", "Susan", "Susanne", "Tanja", "Thomas", "Tim", "Tobias", "Tom", "Ulrich",
    "Ulrike", "Ursula", "Ute", "Uwe", "Vanessa", "Vera", "Walter", "Werner", "William", "Wolfgang", "Yvonne",
]

LAST_NAMES = [
    "Adams", "Albrecht", "Anderson", "Arnold", "Bauer", "Baumann", "Becker", "Beck", "Berger", "Bergmann", "Böhm", "Braun", "Brandt", "Brown", "Busch",
    "Clark", "Davis", "Dietrich", "Engel", "Evans", "Fischer", "Frank", "Franke", "Friedrich", "Fuchs", "Garcia", "Graf", "Green", "Groß", "Günther", "Haas",
    "Hahn", "Hall", "Harris", "Hartmann", "Heinrich", "Herrmann", "Hill", "Hoffmann", "Hofmann", "Horn", "Huber", "Hughes", "Jackson", "Jäger", "Jansen",
    "Johnson", "Jones", "Jung", "Kaiser", "Kaufmann", "Keller", "Klein", "Koch", "Köhler", "König", "Kraus", "Krause", "Krüger", "Kuhn", "Kühn", "Lang",
    "Lange", "Lehmann", "Lewis", "Lorenz", "Ludwig", "Maier", "Martin", "Martinez", "Mayer", "Meier", "Meyer", "Miller", "Mitchell", "Möller", "Moore",
    "Müller", "Neumann", "Otto", "Parker", "Peters", "Pfeiffer", "Phillips", "Pohl", "Richter", "Roberts", "Robinson", "Roth", "Sauer", "Schäfer", "Schmid",
    "Schmidt", "Schmitt", "Schmitz", "Schneider", "Scholz", "Schreiber", "Schröder", "Schubert", "Schulte", "Schulz", "Schulze", "Schumacher", "Schuster",
    "Schwarz", "Scott", "Seidel", "Simon", "Smith", "Sommer", "Stein", "Taylor", "Thomas", "Thompson", "Turner", "Vogel", "Vogt", "Voigt", "Wagner", "Walker",
    "Walter", "Weber", "Weiß", "Werner", "White", "Williams", "Wilson", "Winkler", "Winter", "Wolf", "Wolff", "Wright", "Zimmermann",
]

CITIES = [
    "Aachen", "Augsburg", "Basel", "Berlin", "Bern", "Bielefeld", "Birmingham", "Bochum", "Bonn", "Boston", "Braunschweig", "Bremen", "Bristol", "Chemnitz",
    "Chicago", "Cottbus", "Dallas", "Darmstadt", "Denver", "Dortmund", "Dresden", "Dublin", "Duisburg", "Düsseldorf", "Edinburgh", "Erfurt", "Essen",
    "Frankfurt", "Freiburg", "Genf", "Glasgow", "Göttingen", "Graz", "Hamburg", "Hannover", "Heidelberg", "Heilbronn", "Houston", "Ingolstadt", "Innsbruck",
    "Jena", "Karlsruhe", "Kassel", "Kiel", "Klagenfurt", "Koblenz", "Köln", "Krefeld", "Lausanne", "Leeds", "Leipzig", "Linz", "Liverpool", "London", "Lübeck",
    "Luzern", "Magdeburg", "Mainz", "Manchester", "Mannheim", "München", "Münster", "Nürnberg", "Oldenburg", "Oxford", "Paderborn", "Philadelphia", "Phoenix",
    "Potsdam", "Regensburg", "Rostock", "Saarbrücken", "Salzburg", "Seattle", "Sheffield", "Stuttgart", "Trier", "Ulm", "Washington", "Wien", "Wiesbaden",
    "Wolfsburg", "Wuppertal", "Würzburg", "Zürich",
]
